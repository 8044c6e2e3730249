"""Removal of repeated three-line windows.

Each run of three consecutive lines is a window, known by two independent 64-bit hashes of its normalised lines
(trimmed, lower case). The first occurrence of a window over all documents, by (doc_id, line), stays; the lines of each later one
are covered. Covered positions are merged, one set a text, and the lines at the others are put together again, in time linear in the text's lines. Counting and finding the first occurrence is one
aggregation with partial sums before the shuffle, so a window that a third of all rows hold costs a row per task; the
join of windows with repeated hashes is one that AQE splits where a hash is hot.

A null text has no lines and stays null; texts of fewer than three lines are never changed, and neither are windows of
three blank lines. Ties can't occur: a place is unique. Rows that repeat an id and its text are one document, written
as often as it was read; where one id has different texts, each is a document of its own, in text order. Null ids come
first. Further columns are kept, but for any named n_lines or n_removed, which the new ones replace. A text's lines are held
together in its own row, whatever its length. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.llm.common import let

WINDOW_LINES = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, line, h1, h2): every window of three lines that isn't blank; ``tag`` tells texts under one id apart."""
    lines = F.split(F.col(text_col), "\n", -1)
    hashes = F.transform(lines, lambda x: F.lower(F.trim(x)))
    rows = let(
        hashes,
        lambda a: F.when(
            F.size(a) >= WINDOW_LINES,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - WINDOW_LINES),
                lambda k: let(
                    F.array(*[F.get(a, k + j) for j in range(WINDOW_LINES)]),
                    lambda w: F.when(F.exists(w, lambda x: x != ""), F.struct(k.alias("line"), F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("second"), w).alias("h2"))),
                ),
            ),
        ),
    )
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), rows.alias("rows"))  # the tag once a text, not once a window
    found = found.select("id", "tag", F.explode("rows").alias("w"))
    return found.where("w is not null").select("id", "tag", "w.*")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, covered): for each document with later occurrences, the first lines of their windows."""
    own = windows(docs, id_col, text_col)
    firsts = own.groupBy("h1", "h2").agg(F.min(F.struct("id", "tag", "line")).alias("first"), F.max(F.struct("id", "tag", "line")).alias("last")).where("first <> last")
    later = own.join(firsts, ["h1", "h2"]).where(F.struct("id", "tag", "line") != F.col("first"))
    return later.groupBy("id", "tag").agg(F.collect_set("line").alias("starts"))


def merged(starts: Column) -> Column:
    """The positions that windows from ``starts`` cover, each once."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda k: F.sequence(k, k + (WINDOW_LINES - 1)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences' lines cut from the text, and n_lines and n_removed after the other columns."""
    gone = covered_lines(docs, id_col, text_col).select(F.col("id").alias("gone_id"), F.col("tag").alias("gone_tag"), merged(F.col("starts")).alias("covered"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["gone_id"]) & (rows["tag"] == gone["gone_tag"]), "left")
    lines = F.split("text", "\n", -1)
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "covered")
    kept = let(lines, lambda ls: F.array_join(F.transform(stay(ls), lambda k: F.get(ls, k)), "\n"))
    kept = F.when(F.col("covered").isNull(), F.col("text")).otherwise(kept)
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    return joined.select(*own, kept.alias(text_col), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).alias("n_removed"))
