"""Column-expression helpers and naming rules (no data work of their own)."""
