"""skarn: a PySpark-native analytics engine over property graphs, text and telemetry."""
