"""Operators of the evidence-memory engine."""
