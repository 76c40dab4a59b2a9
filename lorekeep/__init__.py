"""lorekeep: a Spark-native engine for long-lived facts, texts, vectors and graphs."""
