"""Transit telemetry analytics on Spark."""
