"""functions of the allocation engine."""
