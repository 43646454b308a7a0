"""claimlake: a PySpark-native engine for grounded numeric claims and corpus preparation."""

__version__ = "0.1.0"
