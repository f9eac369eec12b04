"""millrace: analytics on Spark DataFrames, one module per family of queries."""
