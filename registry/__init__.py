"""Checked queries over the given tables, with the same results in plain SQL."""
