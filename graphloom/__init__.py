"""Analytics on embeddings and interaction graphs, with Spark DataFrames."""
