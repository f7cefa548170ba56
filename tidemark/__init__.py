"""Market-news analytics as composable Spark DataFrame jobs."""
