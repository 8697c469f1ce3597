"""Functions on columns, also for SQL text."""
