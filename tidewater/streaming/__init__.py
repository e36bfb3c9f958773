"""Market time-series streaming."""
