"""Equipment-telemetry and run analytics as plain Spark DataFrame jobs."""
