"""Session telemetry analytics expressed as PySpark DataFrame jobs."""
