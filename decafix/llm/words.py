"""Words of whole texts with SQL functions alone: runs of digits, letters a-z (lower-cased) and characters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what lies between words, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z alone in lower case; a null is empty. (Where all is ASCII that is what ``lower`` does, which is faster.)"""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """ARRAY<STRING>; a null text has no words."""
    return F.array_remove(F.split(lowered(text), GAPS), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by what it holds, in 128 bits, so that results can be joined back: equal rows share it, null ids and repeated ids
    with other texts don't."""
    return F.concat(F.hex(F.xxhash64(doc_id, text, F.length(text))), F.lit(":"), F.hex(F.xxhash64(F.lit("second"), text, doc_id)))
