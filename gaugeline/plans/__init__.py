"""plans of the alignment engine."""
