"""tracelore: a PySpark-native analytics engine for reasoning traces and text corpora."""
