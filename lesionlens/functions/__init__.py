"""Column-level helpers, fixed values and small numeric functions."""
