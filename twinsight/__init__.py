"""Near-duplicate search, measurement and verification on Spark DataFrames."""
