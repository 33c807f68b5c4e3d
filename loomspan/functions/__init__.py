"""Functions of the combination-rule engine."""
