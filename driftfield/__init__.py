"""driftfield: stochastic-dynamics analytics on Spark DataFrames."""
