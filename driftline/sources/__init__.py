"""Sources of the driftline engine."""
