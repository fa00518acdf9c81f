"""Spark jobs that check, score and monitor card transactions."""
