"""Analytics of particle systems and other point data on Spark DataFrames."""
