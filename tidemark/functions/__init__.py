"""Predicates as column expressions."""
