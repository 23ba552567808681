"""Schema-state analytics and data processing on Spark DataFrames."""
