"""filequarry: a Spark-native engine that indexes and searches collections of files."""

__version__ = "0.1.0"
