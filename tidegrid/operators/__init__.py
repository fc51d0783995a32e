"""Operators on time series."""
