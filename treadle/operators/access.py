"""From ordered open and edit events to counted visits and transitions.

Per root, in order of (ts, event_id): events on paths that aren't alive drop out before the clock; the gap to the event before
decides whether an event is a person's (0.5 s or more) and whether it goes on a session (600 s or less). An open's from-side is
the open before it that passed the gate. A visit or transition counts unless the same one was counted less than
60 s ago and is still among the last eight counted ones of its kind.

All but the last rule are windows inside minutes, with what comes before carried in one row per minute, so one root may
hold most events. The last rule is a fold in order; it starts afresh wherever 60 s pass without a candidate, so it
runs over (root, kind, run) with eight slots as its whole state, row by row, not group by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadle.constants import EDGE_WEIGHT, EDIT_WEIGHT, MAX_GAP_SECS, MIN_GAP_SECS, OPEN_WEIGHT, REPEAT_SECS, REPEAT_SLOTS
from treadle.operators.catalog import alive_at
from treadle.plans.blocks import last_before, minute, running_sum

ORDER = ["ts", "event_id"]


def seconds(later: str, earlier: str) -> F.Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def eligible(events: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Opens and edits of files that are alive when they come. A file that is moved in is edited, by an editor that saves under another name first;
    opens of directories aren't a person's."""
    found = alive_at(events, minute(), entries).where(~F.coalesce("is_dir", F.lit(False)))
    moved = F.col("kind") == "move_in"
    return found.where(moved | (F.col("alive") & F.col("kind").isin("open", "edit"))).withColumn("kind", F.when(moved, "edit").otherwise(F.col("kind"))).drop("alive")


def with_gaps(events: DataFrame) -> DataFrame:
    """``gap`` in seconds to the event before of the same root; the first one's counts as a new session."""
    found = last_before(events, ["root"], minute(), ORDER, F.col("ts"), "_previous")
    return found.withColumn("gap", F.coalesce(seconds("ts", "_previous"), F.lit(MAX_GAP_SECS + 1))).drop("_previous")


def gated(events: DataFrame) -> DataFrame:
    """Events that a person can have made; the clock has moved for the others too."""
    return with_gaps(events).where(F.col("gap") >= MIN_GAP_SECS)


def sessions(events: DataFrame) -> DataFrame:
    """(root, session, started, ended, events) of runs without a gap over 600 s."""
    numbered = running_sum(with_gaps(events), ["root"], minute(), ORDER, (F.col("gap") > MAX_GAP_SECS).cast("long"), "session")
    return numbered.groupBy("root", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def transitions(passed: DataFrame) -> DataFrame:
    """(root, ts, event_id, src, dst) of opens after an open of another file in the same session; ``passed`` is gated."""
    opens = last_before(passed.where("kind = 'open'"), ["root"], minute(), ORDER, F.col("path"), "src")
    return opens.where((F.col("gap") <= MAX_GAP_SECS) & (F.col("src") != F.col("path"))).select("root", *ORDER, "src", F.col("path").alias("dst"))


def candidates(passed: DataFrame) -> DataFrame:
    """(root, kind, ts, event_id, src, dst): opens and edits of src, with null dst, and edges."""
    visits = passed.select("root", "kind", *ORDER, F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"))
    return visits.unionByName(transitions(passed).withColumn("kind", F.lit("edge")))


class RepeatRing:
    """The last eight counted keys of one kind, and when."""

    def __init__(self, slots: list | None = None):
        self.slots = slots or []

    def counts(self, key, now: float) -> bool:
        if any(k == key and now - at < REPEAT_SECS for k, at in self.slots):
            return False
        self.slots = [*self.slots, (key, now)][-REPEAT_SLOTS:]
        return True


def counted(found: DataFrame) -> DataFrame:
    """Those of the candidates that count."""
    breaks = last_before(found, ["root", "kind"], minute(), ORDER, F.col("ts"), "_previous")
    fresh = F.coalesce(seconds("ts", "_previous") >= REPEAT_SECS, F.lit(True))
    runs = running_sum(breaks, ["root", "kind"], minute(), ORDER, fresh.cast("long"), "run").drop("_previous")
    runs = runs.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    ordered = runs.repartition("root", "kind", "run").sortWithinPartitions("root", "kind", "run", *ORDER)
    columns = found.columns

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ring = None, RepeatRing()
        for pdf in parts:
            keep = []
            for root, kind, run, at, src, dst in zip(pdf["root"], pdf["kind"], pdf["run"], pdf["at"], pdf["src"], pdf["dst"], strict=True):
                if (root, kind, run) != group:
                    group, ring = (root, kind, run), RepeatRing()
                keep.append(ring.counts((src, dst if isinstance(dst, str) else None), at / 1e6))
            yield pdf.loc[keep, columns]

    return ordered.mapInPandas(fold, found.schema)


def visit_weights(counts: DataFrame) -> DataFrame:
    """(root, path, opens): what counted opens and edits add to a file."""
    weight = F.when(F.col("kind") == "open", OPEN_WEIGHT).otherwise(EDIT_WEIGHT)
    return counts.where("kind <> 'edge'").groupBy("root", F.col("src").alias("path")).agg(F.sum(weight).alias("opens"))


def edge_weights(counts: DataFrame) -> DataFrame:
    """(root, src, dst, weight) of counted transitions."""
    return counts.where("kind = 'edge'").groupBy("root", "src", "dst").agg(F.sum(F.lit(EDGE_WEIGHT)).alias("weight"))
