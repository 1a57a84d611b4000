"""tessera: a PySpark-native engine for analytical SQL and DataFrame queries."""
