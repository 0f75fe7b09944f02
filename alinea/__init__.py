"""alinea: a Spark-native engine that aligns one structured text corpus to another with checkable evidence."""
