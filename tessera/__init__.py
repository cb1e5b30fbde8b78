"""Tessera: annotated-graph analytics expressed as Spark DataFrames."""
