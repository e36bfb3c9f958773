"""Market time-series sources."""
