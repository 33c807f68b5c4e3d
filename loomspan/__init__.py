"""Combination-rule text analytics and training-data preparation on Spark."""

__version__ = "0.1.0"
