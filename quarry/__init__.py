"""quarry: a Spark-native engine that matches task descriptions to datasets."""
