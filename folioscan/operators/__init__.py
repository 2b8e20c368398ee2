"""DataFrame operators: index building, search, state, structure."""
