"""PySpark-native analytics for urban geospatial data."""

__version__ = "0.1.0"
