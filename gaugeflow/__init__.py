"""gaugeflow: Spark-native sensor analytics (silver rules, time-series features, detectors, streaming)."""
