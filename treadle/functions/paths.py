"""Path expressions. Lengths that decide anything are in bytes, comparisons are by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treadle.constants import BOUNDARIES

ELLIPSIS = "…"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalized(path: Column) -> Column:
    """Without slashes at the end; a path of slashes alone becomes one."""
    return F.regexp_replace(path, r"(?<=.)/+$", "")


def joined(directory: Column, name: Column) -> Column:
    return F.concat(F.when(F.endswith(directory, F.lit("/")), directory).otherwise(F.concat(directory, F.lit("/"))), name)


def under(path: Column, directory: Column) -> Column:
    """The directory itself or anything below it."""
    return (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """The path inside the root: empty for the root, null outside."""
    below = F.when(root == "/", F.lit("/")).otherwise(F.concat(root, F.lit("/")))
    return F.when(path == root, F.lit("")).when(F.startswith(path, below), F.substring(path, F.length(below) + 1, F.length(path)))


def relative_ok(rel: Column) -> Column:
    """May stand in a snapshot: empty, or segments of which none is empty, `.` or `..`, without a NUL."""
    return (rel == "") | (F.forall(F.split(rel, "/", -1), lambda s: ~s.isin("", ".", "..")) & ~F.contains(rel, F.lit("\x00")))


def ancestors(path: Column) -> Column:
    """All directories above an absolute path, the outermost first, without `/`."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def visible(path: Column, root: Column) -> Column:
    """No segment below the root begins with a dot, and the path is valid UTF-8."""
    inside = F.coalesce(relative(path, root), path)
    return ~F.exists(F.split(inside, "/", -1), lambda s: F.startswith(s, F.lit("."))) & F.is_valid_utf8(path)


def tier(path: Column, query: Column | str) -> Column:
    """0 whole name, 1 the name's beginning, 2 at a boundary inside it, 3 elsewhere."""
    q = F.lit(query) if isinstance(query, str) else query
    base = basename(path)
    inner = F.lit(False)
    for b in BOUNDARIES:
        inner = inner | F.contains(base, F.concat(F.lit(b), q))
    return F.when(base == q, 0).when(F.startswith(base, q), 1).when(inner, 2).otherwise(3)


def query_kind(text: Column) -> Column:
    """root for no text; prefix for one byte or a text with a slash; token otherwise."""
    return F.when(text == "", "root").when((F.octet_length(text) == 1) | F.contains(text, F.lit("/")), "prefix").otherwise("token")


def query_prefix(text: Column, root: Column) -> Column:
    """What a prefix query's paths begin with."""
    return F.when(F.startswith(text, F.lit("/")), text).otherwise(joined(root, text))


def abbreviated(path: Column, width: int) -> Column:
    """At most ``width`` characters: the first directory, the last one and the name; then without the first; then the
    name; then its beginning. Every character counts as one column wide."""
    dots = F.lit(ELLIPSIS)
    name = basename(path)
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    last = F.when(n > 1, F.element_at(parts, -2))
    first = F.element_at(parts, 1)
    both = F.when(n > 2, F.concat(first, F.lit("/"), dots, F.lit("/"), last, F.lit("/"), name))
    one = F.concat(dots, F.lit("/"), last, F.lit("/"), name)
    none = F.when(n > 1, F.concat(dots, F.lit("/"), name))
    fits = lambda c: F.length(c) <= width
    return F.when(fits(path), path).when(fits(both), both).when(fits(one), one).when(fits(none), none).otherwise(F.concat(F.substring(name, 1, width - 1), dots))


def fnv1a_64(text: str) -> str:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as 16 hexadecimal digits: a snapshot's name."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
