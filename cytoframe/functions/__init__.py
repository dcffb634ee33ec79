"""Helpers shared by operators."""
