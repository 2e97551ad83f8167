"""Causal operators as Structured Streaming queries."""
