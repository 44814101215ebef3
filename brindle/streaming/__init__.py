"""Bounded queues, staleness and replay."""
