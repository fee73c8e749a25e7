"""Spark-native analytics for mutational-profiling read ensembles."""

__version__ = "0.1.0"
