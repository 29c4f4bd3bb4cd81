"""Mass substring search, text-overlap analytics and corpus preparation on Spark DataFrames."""
