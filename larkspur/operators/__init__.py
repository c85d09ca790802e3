"""DataFrame operators, registered by name."""
