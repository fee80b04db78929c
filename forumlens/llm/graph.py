"""Connected components of a graph of links; the library's own."""

from forumlens.operators.components import components

__all__ = ["components"]
