"""Voice-measurement analytics expressed as Spark DataFrame jobs."""
