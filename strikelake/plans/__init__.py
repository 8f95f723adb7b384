"""Whole analyses: replay, metrics, reports, resampling, sweep, portfolio."""
