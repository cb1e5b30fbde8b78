"""Streaming of the annotated-graph engine."""
