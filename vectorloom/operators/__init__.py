"""Operators of the vector analytics engine."""
