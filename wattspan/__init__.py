"""wattspan: minute-level energy telemetry analytics as PySpark DataFrame jobs."""
