"""sources of the grid-map engine."""
