"""driftline: position-measurement analytics on Spark DataFrames."""
