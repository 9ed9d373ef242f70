"""Sources of the vector analytics engine."""
