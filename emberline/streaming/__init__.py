"""Increments, watches and stateful operators for Structured Streaming."""
