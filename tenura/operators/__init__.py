"""operators of the retention analytics engine."""
