"""Incremental and stateful operators for Structured Streaming."""
