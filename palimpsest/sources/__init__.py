"""Sources of the evidence-memory engine."""
