"""Functions of the change-set engine."""
