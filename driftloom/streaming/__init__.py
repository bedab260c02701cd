"""Streaming of the change-set engine."""
