"""Transit revenue-leakage analytics as Spark DataFrame jobs."""
