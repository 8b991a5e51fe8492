"""Incremental forms of operators whose result is a minimum by key. The analysis itself is a batch."""
