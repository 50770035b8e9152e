"""The ledgers as Structured Streaming queries."""
