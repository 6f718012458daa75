"""Streaming of the driftline engine."""
