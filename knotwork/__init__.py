"""Knotwork: a property-graph analytics engine on Spark DataFrames."""
