"""Bank-transfer data as a graph, on Spark DataFrames."""

from remitgraph.plans.tables import GraphTables

__all__ = ["GraphTables"]
