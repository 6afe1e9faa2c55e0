"""Flight-recorder telemetry analytics on Spark."""
