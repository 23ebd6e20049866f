"""lamina: Spark-native processing of layered text corpora."""
