"""Operators of the annotated-graph engine."""
