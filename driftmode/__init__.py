"""driftmode: density-based mode seeking and region analysis on Spark DataFrames."""
