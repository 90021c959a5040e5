"""Level-synchronous graph analytics on Spark DataFrames."""
