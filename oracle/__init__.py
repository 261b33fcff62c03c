"""Independent SQL statements of every registered query, for comparison only."""
