"""lodestream: a Spark-native engine for code/text corpora and relational queries over them."""
