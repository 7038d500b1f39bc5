"""operators of the allocation engine."""
