"""Graph-of-code analytics on Spark: blocks, typed edges and DataFrame queries over both."""
