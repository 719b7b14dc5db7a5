"""brindle: a PySpark-native catalog, query-text and rule engine."""

__version__ = "0.1.0"
