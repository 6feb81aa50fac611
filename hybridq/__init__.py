"""hybridq: hybrid retrieval and explainable ranking as Spark DataFrame jobs."""
