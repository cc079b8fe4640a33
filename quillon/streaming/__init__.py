"""Keyed state over time, in batch and in Structured Streaming."""
