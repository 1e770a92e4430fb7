"""Retrieval, evaluation and text-data operators as Spark DataFrame plans."""
