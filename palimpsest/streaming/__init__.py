"""Streaming of the evidence-memory engine."""
