"""plans of the allocation engine."""
