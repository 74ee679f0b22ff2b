"""tallyglass: a Spark-native engine for building, checking and scoring question sets over tables."""

__version__ = "0.1.0"
