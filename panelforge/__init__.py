"""Event-study analytics over daily price panels, on Spark DataFrames."""
