"""Change-set analytics on Spark."""
