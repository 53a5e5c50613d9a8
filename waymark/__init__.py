"""Grid-map to waypoint-graph analytics on Spark."""
