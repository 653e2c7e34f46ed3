"""Structured Streaming form of the Gram job (the reference itself reads one file at once)."""
