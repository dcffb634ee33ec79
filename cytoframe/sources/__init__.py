"""Readers of expression matrices, and matrices made from other tables."""

from .ingest import canonicalize, matrix_from_events, matrix_from_text, read_long, read_wide
from .mtx import MatrixMarketSource, read_matrix, read_mtx, write_mtx

__all__ = ["MatrixMarketSource", "canonicalize", "matrix_from_events", "matrix_from_text", "read_long", "read_matrix", "read_mtx", "read_wide", "write_mtx"]
