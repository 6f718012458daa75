"""Functions of the driftline engine."""
