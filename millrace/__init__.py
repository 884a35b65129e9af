"""millrace: the data side of training and evaluating reasoning models, as Spark DataFrame and SQL operations."""
