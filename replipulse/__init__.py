"""Replication health of storage fleets, computed with Spark DataFrames."""
