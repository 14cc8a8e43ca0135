"""Column-level helpers (scalar functions used by the operators)."""
