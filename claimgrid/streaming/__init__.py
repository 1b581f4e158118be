"""Streaming twins of the event checks."""
