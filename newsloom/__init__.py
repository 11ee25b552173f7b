"""newsloom: a PySpark-native analytics engine for news feeds and text corpora."""
