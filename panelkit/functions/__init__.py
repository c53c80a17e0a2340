"""Column-level helpers (no Python row UDFs)."""
