"""streaming of the grid-map engine."""
