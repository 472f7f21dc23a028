"""quern: a PySpark-native analytics engine for text corpora and retrieval."""
