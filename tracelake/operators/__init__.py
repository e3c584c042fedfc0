"""Row-level evaluation: printf, packed values and state dumps, and bucketed range lookups."""
