"""bitik: Spark-native analytics over multi-script Uzbek text."""
