"""functions of the grid-map engine."""
