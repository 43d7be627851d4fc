"""Origin-destination analytics and corpus operators on Spark DataFrames."""
