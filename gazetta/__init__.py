"""gazetta: a PySpark-native engine for free-text locality records."""
