"""operators of the grid-map engine."""
