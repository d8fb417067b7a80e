"""Sources (S1-S8) and sinks (K1-K8)."""
