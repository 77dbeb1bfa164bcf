"""A PySpark-native engine for append-only, content-addressed graph logs."""
