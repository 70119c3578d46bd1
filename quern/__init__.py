"""quern: exact and approximate analytics on Spark, built on DataFrames, SQL and Structured Streaming."""
