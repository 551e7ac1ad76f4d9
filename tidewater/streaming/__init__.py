"""Live bars with Structured Streaming."""
