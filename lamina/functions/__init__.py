"""Part of lamina, a Spark-native document analytics engine."""
