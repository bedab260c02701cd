"""Operators of the change-set engine."""
