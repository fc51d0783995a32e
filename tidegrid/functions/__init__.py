"""Part of the time-series engine: functions."""
