"""Index tables, filters and ranking as DataFrame operations."""
