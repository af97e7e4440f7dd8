"""Analytics over content-addressed, deduplicated snapshot stores, on Spark DataFrames."""
