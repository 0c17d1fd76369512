"""sources of the alignment engine."""
