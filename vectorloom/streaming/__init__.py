"""Streaming of the vector analytics engine."""
