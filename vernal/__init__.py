"""vernal: Spark-native surface-water and wetland screening analytics."""

__version__ = "0.1.0"
