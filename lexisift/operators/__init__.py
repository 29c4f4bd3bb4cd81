"""Search, overlap, distinct-substring and extraction operators on DataFrames."""
