"""plans of the retention analytics engine."""
