"""lexmill: a Spark-native text retrieval and corpus analytics engine."""
