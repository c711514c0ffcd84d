"""sources of the retention analytics engine."""
