"""Registered queries over the driver's tables, each with SQL that checks it."""
