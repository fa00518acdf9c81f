"""Whole jobs: scoring, training, and the registered queries."""
