"""Whole runs and the query catalogue, composed from operators."""
