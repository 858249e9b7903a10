"""presslens: a Spark-native engine for comparing how news sources write."""
