"""functions of the retention analytics engine."""
