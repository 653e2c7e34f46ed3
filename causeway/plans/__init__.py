"""Derived frames, the step chain, the full analysis and the query catalog."""
