"""Column functions: equality rules and row digests."""
