"""Registered queries over the driver's tables, and the end-to-end analysis."""
