"""Span-grounded text analytics on Spark."""
