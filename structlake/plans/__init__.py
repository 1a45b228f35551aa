"""Registered queries and their DuckDB forms."""

from . import extended, registry

__all__ = ["extended", "registry"]
