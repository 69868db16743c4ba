"""Record matching and corpus processing on Spark DataFrames."""
