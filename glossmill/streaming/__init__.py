"""Streaming forms of operators that keep a running state."""
