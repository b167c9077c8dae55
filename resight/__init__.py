"""Analytics of repeatedly observed records, as functions from DataFrames to DataFrames."""
