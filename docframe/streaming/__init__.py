"""Event-driven checks with Structured Streaming."""
