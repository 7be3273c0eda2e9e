"""Place analytics and geocoding on Spark DataFrames."""
