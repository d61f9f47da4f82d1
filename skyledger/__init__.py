"""skyledger: Spark-native analytics for single-pass aerial capture data."""
