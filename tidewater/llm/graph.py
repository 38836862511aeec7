"""Distributed union-find, for links of lines and documents: the library's own."""

from ..operators.graph import components

__all__ = ["components"]
