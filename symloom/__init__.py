"""symloom: a PySpark-native symbol-graph analytics engine."""

__version__ = "0.1.0"
