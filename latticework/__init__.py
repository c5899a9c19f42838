"""Service-topology analytics on Spark: facts, graph operators, matching joins and reports as DataFrames."""
