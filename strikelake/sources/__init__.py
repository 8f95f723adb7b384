"""Readers and writers for bars and result tables."""
