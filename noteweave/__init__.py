"""noteweave: Spark-native analytics over free-text clinical notes and large text corpora."""

__version__ = "0.1.0"
