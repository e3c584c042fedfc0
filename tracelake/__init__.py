"""tracelake: a PySpark-native engine for structured operating-system log archives."""
