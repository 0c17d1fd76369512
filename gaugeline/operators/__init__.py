"""operators of the alignment engine."""
