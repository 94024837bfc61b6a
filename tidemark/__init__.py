"""Event-time window analytics expressed as Spark DataFrame plans."""
