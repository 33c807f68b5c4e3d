"""Plans of the combination-rule engine."""
