"""lattice: property-graph analytics and hybrid search over Spark DataFrames."""
