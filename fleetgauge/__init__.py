"""fleetgauge: validation of drive logs at fleet scale, on Spark DataFrames."""
