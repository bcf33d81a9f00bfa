"""Citation-recommendation analytics as Spark DataFrame programs."""
