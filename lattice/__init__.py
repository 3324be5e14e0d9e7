"""lattice: strict JSON queries, pivots and trees over Spark DataFrames."""
