"""wardline: safety and governance analytics as Spark DataFrames."""
