"""Public-spending flow analytics on PySpark."""
