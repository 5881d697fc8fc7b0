"""Graph-grounded retrieval, ranking and evaluation on PySpark."""
