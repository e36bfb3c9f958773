"""Market time-series operators."""
