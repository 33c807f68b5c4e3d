"""Operators of the combination-rule engine."""
