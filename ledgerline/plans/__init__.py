"""End-to-end plans: datasets, runs and the query catalogue."""
