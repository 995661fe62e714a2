"""Repository analytics and large-scale data processing on PySpark."""
