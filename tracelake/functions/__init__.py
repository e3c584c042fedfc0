"""Code tables and value decoders as column functions."""
