"""DataFrame operators of the core engine."""
