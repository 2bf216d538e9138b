"""speechtab: Spark-native annotation and table work for speech corpora."""

__version__ = "0.1.0"
