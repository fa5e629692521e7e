"""Analytics over inference-call telemetry, written as Spark DataFrame jobs."""
