"""Network cross-validation jobs and training-data operators on PySpark."""
