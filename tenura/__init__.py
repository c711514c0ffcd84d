"""tenura: subscription-retention analytics as composable Spark jobs."""

__version__ = "0.1.0"
