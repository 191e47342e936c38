"""Operators on DataFrames: filters, aggregates, windows, codecs, bitmaps and transforms."""
