"""seqloom: Spark-native clustering of biological sequences and of text cast as sequences."""

__version__ = "0.1.0"
