"""Block-compression analytics and training-data operators on PySpark."""
