"""The catalog of paths: upserts, tombstones, subtree deletes and reconciliation with a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.functions.paths import ancestors, under, visible
from treadle.plans.blocks import last_before

KEYS = ["root", "path"]
COLUMNS = [*KEYS, "is_dir", "dead"]


def visible_entries(listing: DataFrame) -> DataFrame:
    return listing.where(visible(F.col("path"), F.col("root")))


def upsert(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (root, path, is_dir) inserted or revived, with its type; other entries stay as they are."""
    new = incoming.select(*KEYS, F.col("is_dir").alias("new_dir"), F.lit(True).alias("came")).dropDuplicates(KEYS)
    both = entries.join(new, KEYS, "full")
    return both.select(*KEYS, F.coalesce("new_dir", "is_dir").alias("is_dir"), (F.coalesce("dead", F.lit(False)) & F.col("came").isNull()).alias("dead"))


def delete_subtree(entries: DataFrame, directory: str) -> DataFrame:
    """A directory and all below it dead; newly_dead marks rows that were alive."""
    gone = under(F.col("path"), F.lit(directory))
    return entries.select(*KEYS, "is_dir", (F.col("dead") | gone).alias("dead"), (gone & ~F.col("dead")).alias("newly_dead"))


def reconcile(entries: DataFrame, listing: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Entries after a listing: those in it alive, the others dead, but for what lies under a directory that couldn't be listed.

    Entries meet unreadable directories by equality with their own path and those above it, not by a prefix join.
    """
    after = upsert(entries, listing)
    seen = after.join(listing.select(*KEYS, F.lit(True).alias("seen")).dropDuplicates(KEYS), KEYS, "left")
    if unreadable is not None:
        lines = entries.select(*KEYS, F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("dir"))
        kept = lines.join(unreadable, ["root", "dir"], "left_semi").select(*KEYS, F.lit(True).alias("kept")).distinct()
        seen = seen.join(kept, KEYS, "left").withColumn("seen", F.coalesce("seen", "kept")).drop("kept")
    return seen.select(*KEYS, "is_dir", (F.col("dead") | F.col("seen").isNull()).alias("dead"))


MADE, GONE = ("create", "move_in"), ("delete", "move_out")


def changes(events: DataFrame) -> DataFrame:
    """(root, path, ts, event_id, made, is_dir, deep): what creates and deletes do to a path. A delete of a directory, or the loss of the root, is
    deep: it takes all below along."""
    made, lost = F.col("kind").isin(*MADE), F.col("kind") == "root_gone"
    found = events.where(made | lost | F.col("kind").isin(*GONE))
    deep = ~made & (F.col("is_dir") | lost)
    return found.select("root", F.when(lost, F.col("root")).otherwise(F.col("path")).alias("path"), "ts", "event_id", made.alias("made"), "is_dir", F.coalesce(deep, F.lit(False)).alias("deep"))


def dirs_above(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with each directory above their path as ``dir``."""
    return df.select("root", "path", *columns, F.explode(ancestors(F.col("path"))).alias("dir"))


def lifecycle(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries after creates and deletes: the last change of a path or, if that comes later, the last deep one above it decides.

    Paths meet the directories that were deleted by equality with those above them, not by a prefix join.
    """
    found = changes(events)
    place = F.struct("ts", "event_id")
    last = found.groupBy(*KEYS).agg(F.max_by(F.struct("made", "is_dir"), place).alias("last"), F.max(place).alias("at"), F.bool_or("made").alias("ever"))
    both = entries.join(last, KEYS, "full")
    known = both.where(F.col("dead").isNotNull() | F.col("ever"))
    deep = found.where("deep").groupBy("root", F.col("path").alias("dir")).agg(F.max(place).alias("gone"))
    if deep.isEmpty():
        known = known.withColumn("gone", F.lit(None).cast(deep.schema["gone"].dataType))
    else:
        above = dirs_above(known).join(deep, ["root", "dir"]).groupBy(*KEYS).agg(F.max("gone").alias("gone"))
        known = known.join(above, KEYS, "left")
    later = F.col("gone").isNotNull() & (F.col("at").isNull() | (F.col("gone") > F.col("at")))
    dead = F.when(later, True).when(F.col("last").isNotNull(), ~F.col("last.made")).otherwise(F.col("dead"))
    return known.select(*KEYS, F.coalesce(F.when(F.col("last.made"), F.col("last.is_dir")), "is_dir", "last.is_dir").alias("is_dir"), dead.alias("dead"))


def alive_at(events: DataFrame, block: Column, entries: DataFrame | None = None) -> DataFrame:
    """``events`` with ``alive``: whether the path is in the catalog and alive when the event comes. Without ``entries`` every path is, at first."""
    order = ["ts", "event_id"]
    made = F.when(F.col("kind").isin(*MADE), True).when(F.col("kind").isin(*GONE), False)
    change = F.when(made.isNotNull(), F.struct(made.alias("made"), *order))
    found = last_before(events, KEYS, block, order, change, "changed")
    deep = changes(events).where("deep").select("root", F.col("path").alias("dir"), *order)
    later = F.lit(False)
    if not deep.isEmpty():
        asked = dirs_above(events.where(F.col("kind").isin("open", "edit")), *order).join(deep.select("root", "dir").distinct(), ["root", "dir"], "left_semi")
        lines = asked.select("root", "dir", *order, "path").unionByName(deep.withColumn("path", F.lit(None).cast("string")))
        gone = last_before(lines, ["root", "dir"], block, order, F.when(F.col("path").isNull(), F.struct(*order)), "gone").where("path is not null and gone is not null")
        found = found.join(gone.groupBy(*KEYS, *order).agg(F.max("gone").alias("gone")), [*KEYS, *order], "left")
        later = F.col("gone").isNotNull() & (F.col("changed").isNull() | (F.col("gone") > F.struct("changed.ts", "changed.event_id")))
    if entries is None:
        start = F.lit(True)
    else:
        found = found.join(entries.select(*KEYS, (~F.col("dead")).alias("at_start")), KEYS, "left")
        start = F.coalesce("at_start", F.lit(False))
    return found.withColumn("alive", F.when(later, False).otherwise(F.coalesce("changed.made", start))).drop("changed", "gone", "at_start")


def status(entries: DataFrame, events: DataFrame) -> DataFrame:
    """One row per root: live entries, whether it is lost, and generations that move with every change."""
    live = entries.groupBy("root").agg(F.count_if(~F.col("dead")).cast("int").alias("indexed"))
    moved = events.groupBy("root").agg(
        F.coalesce(F.bool_or(F.col("kind") == "root_gone"), F.lit(False)).alias("root_lost"),
        F.count_if(F.col("kind").isin(*MADE, *GONE)).alias("index_gen"),
        F.count_if(F.col("kind").isin("open", "edit")).alias("score_gen"),
    )
    both = live.join(moved, "root", "left")
    lost = F.coalesce("root_lost", F.lit(False))
    return both.select("root", F.when(lost, 0).otherwise(F.col("indexed")).alias("indexed"), F.lit(True).alias("scan_done"), F.lit(0).alias("unwatched"), lost.alias("root_lost"), F.coalesce("index_gen", F.lit(0)).alias("index_gen"), F.coalesce("score_gen", F.lit(0)).alias("score_gen"))
