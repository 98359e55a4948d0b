"""Marginalia: vault analytics (notes, links, canvases, paged references) on PySpark."""

__version__ = "0.1.0"
