"""A PySpark-native analytics engine for unit x period x category panels."""

__version__ = "0.1.0"
