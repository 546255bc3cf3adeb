"""Analytics over multi-channel recordings, on Spark DataFrames."""
