"""Events as they come: the catalog, the counted visits and transitions, and the ranking, batch by batch.

Each stream reads new files of events, runs until none is left (or with a given trigger), and writes each batch's result
under its number, so that a batch that is run again replaces its own rows only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treadle.constants import MAX_GAP_SECS, MIN_GAP_SECS
from treadle.operators import access, catalog, rank
from treadle.operators.access import RepeatRing
from treadle.plans.storage import shared_dir, stored
from treadle.sources.tables import bound, table

COUNTED = "root string, kind string, ts timestamp_ntz, event_id long, src string, dst string"
STATE = "last_at double, last_path string, memory string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Bound events from the Parquet files of a folder, in batches of files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return bound(raw)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", place: str | None = None) -> None:
    """``place``: a shared folder that keeps how far the stream came; another run with the same one goes on from there."""
    place = place or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """The rows of all batches, read back from the shared folder."""
    spark = stream.sparkSession
    place = place or f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batches/batch={number}")

    run_batches(stream, each, mode, place)
    return spark.read.schema(stream.schema).parquet(f"{place}/batches/*")


class Versions:
    """Tables as they are after each batch, in a shared folder. A batch that is run again starts from the one before it and
    replaces its own version."""

    def __init__(self, spark: SparkSession, place: str | None, **schemas: str):
        self.spark, self.place, self.schemas = spark, place or f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", schemas

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{at}")

    def last(self, before: int | None = None) -> dict[str, DataFrame] | None:
        """The newest whole version, of a batch before the given one; None if there is none."""
        done = self._path("done-*")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        numbers = [int(f.getPath().getName().rsplit("-", 1)[1]) for f in found or []]
        newest = max((n for n in numbers if before is None or n < before), default=None)
        return None if newest is None else {k: self.spark.read.schema(v).parquet(f"{self.place}/{k}-{newest}") for k, v in self.schemas.items()}

    def keep(self, number: int, **tables: DataFrame) -> None:
        for k, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.place}/{k}-{number}")
        mark = self._path(f"done-{number}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()


class Alive:
    """Which paths are alive, from creates and deletes in order; what nothing was heard of is. Deletes of directories are kept as such."""

    def __init__(self, changed: dict | None = None, gone: dict | None = None):
        self.changed, self.gone = changed or {}, gone or {}

    def take(self, kind: str, root: str, path: str, is_dir: bool, at: list) -> None:
        if kind in catalog.MADE:
            self.changed.pop(path, None)
            if self._gone(path):
                self.changed[path] = [True, at]
        elif kind == "root_gone" or (kind in catalog.GONE and is_dir):
            top = root if kind == "root_gone" else path
            self.gone[top] = at
            below = f"{top}/"
            self.changed = {p: c for p, c in self.changed.items() if not p.startswith(below)}
            self.gone = {d: c for d, c in self.gone.items() if not d.startswith(below)}
        elif kind in catalog.GONE:
            self.changed[path] = [False, at]

    def _gone(self, path: str) -> list | None:
        parts = path.split("/") if self.gone else []
        above = ["/".join(parts[:k]) for k in range(2, len(parts))]
        return max((self.gone[d] for d in above if d in self.gone), default=None)

    def __call__(self, path: str) -> bool:
        made, at = self.changed.get(path, (True, None))
        gone = self._gone(path)
        return made and (gone is None or (at is not None and at > gone))


def count_events(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One root's events of a batch, in order, against what is kept of those before."""
    rows = pd.concat(parts).sort_values(["ts", "event_id"], kind="stable")
    last_at, last_path, memory = state.get if state.exists else (None, None, None)
    kept = json.loads(memory) if memory else {"changed": {}, "gone": {}, "open": [], "edit": [], "edge": []}
    alive = Alive(kept["changed"], kept["gone"])
    rings = {k: RepeatRing([((s, d), at) for (s, d), at in kept[k]]) for k in ("open", "edit", "edge")}
    out = []
    for row in rows.itertuples(index=False):
        now, is_dir = row.ts.value / 1e9, bool(row.is_dir)
        alive.take(row.kind, key[0], row.path, is_dir, [row.ts.value, row.event_id])
        kind = "edit" if row.kind == "move_in" else row.kind
        if kind in ("open", "edit") and not is_dir and alive(row.path):
            gap = MAX_GAP_SECS + 1 if last_at is None else round(now - last_at, 6)
            last_at = now
            if gap < MIN_GAP_SECS:
                continue
            if rings[kind].counts((row.path, None), now):
                out.append((key[0], kind, row.ts, row.event_id, row.path, None))
            if kind == "open":
                src = last_path if gap <= MAX_GAP_SECS else None
                last_path = row.path
                if src and src != row.path and rings["edge"].counts((src, row.path), now):
                    out.append((key[0], "edge", row.ts, row.event_id, src, row.path))
    state.update((last_at, last_path, json.dumps({"changed": alive.changed, "gone": alive.gone} | {k: r.slots for k, r in rings.items()})))
    yield pd.DataFrame(out, columns=["root", "kind", "ts", "event_id", "src", "dst"])


def counted_stream(events: DataFrame) -> DataFrame:
    """Counted visits and transitions; all files are alive before the first event. State per root: the clock, the last file, three rings, paths that
    aren't as they were at first, and directories that were deleted."""
    return events.groupBy("root").applyInPandasWithState(count_events, COUNTED, STATE, "append", GroupStateTimeout.NoTimeout)


def applied(events: DataFrame, entries: DataFrame, place: str | None = None) -> DataFrame:
    """The catalog after all batches, from ``entries`` before the first; each batch's result is a stored version."""
    kept = Versions(entries.sparkSession, place, entries="root string, path string, is_dir boolean, dead boolean")
    first = stored(entries)

    def each(batch: DataFrame, number: int) -> None:
        before = kept.last(number)
        kept.keep(number, entries=catalog.lifecycle(before["entries"] if before else first, stored(batch)))

    run_batches(events, each, place=kept.place)
    after = kept.last()
    return after["entries"] if after else first


def ranked(events: DataFrame, place: str | None = None) -> DataFrame:
    """(root, path, p, r) kept up to date: each batch adds its counted visits and transitions, and the rank goes on from there."""
    kept = Versions(events.sparkSession, place, opens="root string, path string, opens double", edges="root string, src string, dst string, weight double", rank="root string, path string, p double, r double")

    def each(batch: DataFrame, number: int) -> None:
        found, before = stored(batch), kept.last(number)
        opens, edges = access.visit_weights(found), access.edge_weights(found)
        if before:
            opens, edges = rank.apply_opens(before["opens"], opens), rank.apply_deltas(before["edges"], edges)
        opens, edges = stored(opens), stored(edges)
        settled = before["rank"] if before else opens.select("root", "path", F.lit(0.0).alias("p"))
        kept.keep(number, opens=opens, edges=edges, rank=rank.incremental_rank(opens, settled, edges, epsilon=0.0))

    run_batches(counted_stream(events), each, place=kept.place)
    after = kept.last()
    return after["rank"] if after else events.sparkSession.createDataFrame([], kept.schemas["rank"])


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, a file a batch."""
    schema = table(spark, sf_dir, "events").schema
    return bound(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))
