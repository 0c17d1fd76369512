"""streaming of the alignment engine."""
