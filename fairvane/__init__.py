"""fairvane: telemetry quality control and corpus preparation on Apache Spark."""
