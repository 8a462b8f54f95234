"""brindle: table pipelines, data tests, privacy, comparison and training-data operators as Spark jobs."""
