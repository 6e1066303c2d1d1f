"""palimpsest: bitemporal evidence memory as Spark DataFrames."""
