"""Registered queries: each operator on the given tables, with its SQL check."""
