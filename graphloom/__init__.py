"""graphloom: document collections to a queryable knowledge graph, on Spark DataFrames."""
