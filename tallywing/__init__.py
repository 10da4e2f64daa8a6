"""Payment-transaction analytics operators on Spark DataFrames."""
