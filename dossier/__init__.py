"""dossier: a Spark-native engine for evidence tables, hierarchical scoring and corpus preparation."""

__version__ = "0.1.0"
