"""Point-in-time market-state analytics on PySpark."""
