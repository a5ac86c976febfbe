"""Registered queries, built from the operators, each beside its SQL check."""
