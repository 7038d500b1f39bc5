"""sources of the allocation engine."""
