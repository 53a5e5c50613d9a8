"""plans of the grid-map engine."""
