"""meridian: a Spark-native engine for versioned vector collections and corpus preparation."""

__version__ = "0.1.0"
