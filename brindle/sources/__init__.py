"""Readers, sinks and row order."""
