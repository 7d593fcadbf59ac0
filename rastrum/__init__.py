"""Rastrum: integer signal and raster analytics as Spark plans."""

__version__ = "0.1.0"
