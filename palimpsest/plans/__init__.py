"""Plans of the evidence-memory engine."""
