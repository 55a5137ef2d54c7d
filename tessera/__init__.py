"""DataFrame-first analytics, preference-data and alignment operators for Spark."""
