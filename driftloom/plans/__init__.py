"""Plans of the change-set engine."""
