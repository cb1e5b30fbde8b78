"""Plans of the annotated-graph engine."""
