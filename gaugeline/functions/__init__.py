"""functions of the alignment engine."""
