"""streaming of the retention analytics engine."""
