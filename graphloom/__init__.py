"""Graphloom: sequence-graph analytics expressed as Spark DataFrames."""
