"""Sources of the annotated-graph engine."""
