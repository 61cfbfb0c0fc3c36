"""Incremental maintenance as Structured Streaming; windows and watermarks are an extension."""
