"""Market time-series functions."""
