"""Column functions: time, geometry, deterministic noise."""
