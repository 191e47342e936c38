"""Precision-bounded analytics on Spark: bounded columns, codecs, bitmaps and streams."""

__version__ = "0.1.0"
