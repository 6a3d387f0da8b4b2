"""Millrace: incremental analytics over document collections, on Spark DataFrames."""
