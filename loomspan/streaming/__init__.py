"""Streaming of the combination-rule engine."""
