"""Neighbour analytics on Spark: distances, ranks, quality curves, trees, affinities and embeddings as DataFrames."""
