"""Readers of registry, corpus and cohort files, and versioned writers."""
