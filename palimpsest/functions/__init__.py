"""Functions of the evidence-memory engine."""
