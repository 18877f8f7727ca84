"""Event-sourced order processing on Spark DataFrames and Structured Streaming."""
