"""loam: a Spark-native engine for scoped, long-lived text memories."""
