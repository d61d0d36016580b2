"""Labour-market analytics as Spark DataFrame jobs."""
