"""Weftline: iterative, partitioned dataflow analytics on Spark DataFrames."""
