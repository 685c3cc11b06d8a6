"""tideline: a Spark-native engine for revision-aware, mixed-frequency series."""
