"""Learning-content and assessment analytics as Spark DataFrame jobs."""
