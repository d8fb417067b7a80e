"""Column-expression helpers (all JVM-side) and the few Arrow UDFs."""
