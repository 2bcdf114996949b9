"""Tables shaped as series, and the query catalogue."""
