"""PySpark-native evidence resolution and stratified ranking."""

__version__ = "0.1.0"
