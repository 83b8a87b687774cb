"""Dynamic linear models over Spark DataFrames of keyed, time-ordered series."""
