"""textpanel: a PySpark-native engine for turning text collections into tested panel data sets."""

__version__ = "0.1.0"
