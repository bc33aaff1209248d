"""Planning: schema alignment, key ranges, and the comparison itself."""
