"""Analysis operators. Each takes a DataFrame (and a CausalSpec) and returns a DataFrame."""
