"""Plans of the driftline engine."""
