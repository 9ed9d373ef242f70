"""Functions of the vector analytics engine."""
