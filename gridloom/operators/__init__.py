"""Operators: each `detect_*` runs one small aggregate job and returns a record; each `apply_*` is a lazy plan."""
