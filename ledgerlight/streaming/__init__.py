"""Structured Streaming versions of the jobs whose input keeps arriving."""
