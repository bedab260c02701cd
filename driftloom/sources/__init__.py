"""Sources of the change-set engine."""
