"""Document-retrieval analytics as Spark jobs."""
