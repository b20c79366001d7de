"""tracewright: a PySpark-native analytics engine for action trajectories."""
