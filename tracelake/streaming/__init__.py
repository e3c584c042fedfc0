"""Micro-batch streaming and bookmarks."""
