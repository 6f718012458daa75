"""Operators of the driftline engine."""
