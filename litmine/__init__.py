"""litmine: literature mining as PySpark DataFrame operators."""
