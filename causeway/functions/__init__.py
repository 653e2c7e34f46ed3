"""Column-expression helpers (JVM-side) and small driver-side distribution functions."""
