"""Plans of the vector analytics engine."""
