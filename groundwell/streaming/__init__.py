"""Structured Streaming forms of the stateful operators, and event-time extensions."""
