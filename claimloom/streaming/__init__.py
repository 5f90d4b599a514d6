"""Structured Streaming versions of the stateful jobs."""
