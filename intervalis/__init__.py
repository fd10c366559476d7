"""A PySpark-native engine for keyed, time-interval collections."""

__version__ = "0.1.0"
