"""Document-retrieval analytics on PySpark."""
