"""tidemark: a Spark-native change-data-capture and training-data engine."""

__version__ = "0.1.0"
