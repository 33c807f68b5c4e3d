"""Sources of the combination-rule engine."""
