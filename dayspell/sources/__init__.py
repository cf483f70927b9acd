"""Readers. `parse_*` works on lines or rows that are already a DataFrame."""
