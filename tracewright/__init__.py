"""PySpark-native analytics over object-centric event logs."""
