"""Tokens of names: the whole name and every suffix of every segment between boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.constants import MIN_TOKEN_BYTES
from treadle.functions.paths import basename

SEGMENT_BREAK = r"[.\-_ ]"


def segments(name: Column) -> Column:
    return F.filter(F.split(name, SEGMENT_BREAK, -1), lambda s: s != "")


def suffixes(segment: Column) -> Column:
    """Every suffix by code points, the longest first; the segment isn't empty."""
    return F.transform(F.sequence(F.lit(1), F.length(segment)), lambda k: F.substring(segment, k, F.length(segment)))


def tokens(name: Column) -> Column:
    found = F.concat(F.array(name), F.flatten(F.transform(segments(name), suffixes)))
    return F.array_distinct(F.filter(found, lambda t: F.octet_length(t) >= MIN_TOKEN_BYTES))


def postings(entries: DataFrame) -> DataFrame:
    """(token, root, path), one row for each distinct token of a path's name; dead entries too. A path that several entries have counts once."""
    return entries.select("root", "path").distinct().select(F.explode(tokens(basename(F.col("path")))).alias("token"), "root", "path")


def probe_segments(text: str) -> list[str]:
    """The parts of a query that may be looked up: between boundaries, of two bytes or more, in order."""
    import re

    return [s for s in re.split(SEGMENT_BREAK, text) if len(s.encode()) >= MIN_TOKEN_BYTES]
