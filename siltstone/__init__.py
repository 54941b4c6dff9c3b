"""siltstone: retrieval, graph, analytics and data-preparation operators on Spark DataFrames."""
