"""xrel: cross-table relationships as DataFrame, SQL and Structured Streaming jobs."""
