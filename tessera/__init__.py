"""tessera: a Spark-native engine for document, vector, record and evaluation analytics."""
