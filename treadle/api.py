"""One root's catalog, history and rank, as methods: open, reconcile, record, query, reply, status, decay, forget, save."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.constants import DECAY_INTERVAL_SECS, HALF_LIFE_SECS, SNAPSHOT_SECS, TOP_K
from treadle.functions import tokens
from treadle.operators import access, catalog, rank, reply, search, snapshot
from treadle.plans.storage import stored, stored_sorted

ENTRY = "root string, path string, is_dir boolean, dead boolean"
OPENS = "root string, path string, opens double"
EDGES = "root string, src string, dst string, weight double"
RANK = "root string, path string, p double, r double"
#: Parts of the postings from which on they are written as one.
PARTS = 16


class Engine:
    """Every method that changes something writes the new tables to the shared folder and goes on from those."""

    def __init__(self, spark: SparkSession, root: str, folder: str, half_life: float = HALF_LIFE_SECS, identity: tuple[int, int, int] = (0, 0, 0), lister: Callable[[], tuple] | None = None):
        """``identity``: the root's device, inode and time of birth, by which its snapshot is found after a rename. ``lister`` gives a
        complete listing and the directories that couldn't be listed; it's asked when events were lost."""
        self.spark, self.root, self.folder, self.half_life, self.identity = spark, root, folder, half_life, identity
        empty = lambda schema: spark.createDataFrame([], schema)
        self.entries, self.opens, self.edges, self.rank = empty(ENTRY), empty(OPENS), empty(EDGES), empty(RANK)
        self.postings: DataFrame | None = None  # of every path that was ever known, in parts sorted by token
        self.parts, self._scored = 0, None
        self.lister, self.root_lost, self.last_save = lister, False, int(time.time())
        self.last_decay, self.changed, self.scan_done, self.index_gen, self.score_gen = int(time.time()), False, False, 0, 0

    def open(self, identity_of=lambda path: None) -> bool:
        """Load the newest snapshot, or the one of the root's former name; False if there is none."""
        found = snapshot.load(self.spark, self.folder, self.root)
        if found is None:
            old = snapshot.adoptable(self.spark, self.folder, self.root, self.identity, identity_of)
            if old is None:
                return False
            found, self.changed = snapshot.load(self.spark, self.folder, self.root, old), True
        nodes, edges, head = found
        self.entries = nodes.select("root", "path", "is_dir", F.lit(False).alias("dead"))
        self.opens = nodes.where("opens > 0").select("root", "path", "opens")
        self.rank = nodes.select("root", "path", F.col("pgrk").alias("p"), F.lit(0.0).alias("r"))
        ends = nodes.select("root", "path", "id")
        named = edges.join(ends.withColumnsRenamed({"id": "src", "path": "src_path"}), ["root", "src"]).join(ends.withColumnsRenamed({"id": "dst", "path": "dst_path"}), ["root", "dst"])
        self.edges = named.select("root", F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "weight")
        self._index(self.entries)
        self.last_decay = head["last_decay"] or int(time.time())
        self.decay(int(time.time()))
        return True

    def _index(self, fresh: DataFrame) -> None:
        """Add the tokens of new entries; many small parts become one."""
        self._scored = None
        found = stored_sorted(tokens.postings(fresh), "token")
        self.postings = found if self.postings is None else self.postings.unionByName(found)
        self.parts += 1
        if self.parts > PARTS:
            self.postings, self.parts = stored_sorted(self.postings, "token"), 1

    def _replace(self, after: DataFrame) -> None:
        before, self.entries = self.entries, stored(after)
        fresh = self.entries.join(before, catalog.KEYS, "left_anti")
        if not fresh.isEmpty():
            self._index(fresh)
        self._scored = None

    def reconcile(self, listing: DataFrame, unreadable: DataFrame | None = None) -> None:
        """Take in a complete listing (root, path, is_dir)."""
        self._replace(catalog.reconcile(self.entries, catalog.visible_entries(listing), unreadable))
        self.scan_done, self.changed, self.index_gen = True, True, self.index_gen + 1

    def record(self, events: DataFrame) -> None:
        """Take in events (event_id, ts, root, path, kind, is_dir), in their own order. After an ``overflow`` the tree is listed again; with
        ``root_gone`` the root is lost."""
        counts = stored(access.counted(access.candidates(access.gated(access.eligible(events, self.entries)))))
        self._replace(catalog.lifecycle(self.entries, events))
        self.opens = stored(rank.apply_opens(self.opens, access.visit_weights(counts)))
        self.edges = stored(rank.apply_deltas(self.edges, access.edge_weights(counts)))
        self.rank, self._scored = stored(rank.incremental_rank(self.opens, self.rank, self.edges)), None
        self.changed, self.index_gen, self.score_gen = True, self.index_gen + 1, self.score_gen + 1
        special = {r["kind"] for r in events.where(F.col("kind").isin("overflow", "root_gone")).select("kind").distinct().collect()}
        self.root_lost = self.root_lost or "root_gone" in special
        if "overflow" in special and self.lister and not self.root_lost:
            self.reconcile(*self.lister())

    def tick(self, now: int) -> str | None:
        """What is due by the clock: decay, and a snapshot if something has changed; where that was written, or None."""
        self.decay(now)
        if now - self.last_save < SNAPSHOT_SECS:
            return None
        self.last_save = now
        return self.save()

    def scored(self) -> DataFrame:
        """The catalog with scores, joined once after each change."""
        if self._scored is None:
            self._scored = stored(rank.synced(self.entries, self.rank))
        return self._scored

    def query(self, text: str, limit: int = TOP_K) -> DataFrame:
        """The best hits; parts of names are looked up in the postings."""
        if self.postings is not None and search.by_token(text):
            return search.top(search.indexed_matches(self.scored(), self.postings, self.root, text), limit)
        return search.search(self.scored(), self.root, text, limit)

    def lines(self, text: str, limit: int = TOP_K) -> list[str]:
        """The hits' paths, the best first: 20 at most."""
        return [r["path"] for r in reply.plain_lines(reply.best_first(self.query(text, limit))).collect()]

    def status(self) -> dict:
        live = self.entries.where(~F.col("dead")).count()
        return {"root": self.root, "indexed": 0 if self.root_lost else live, "scan_done": self.scan_done, "unwatched": 0, "root_lost": self.root_lost, "index_gen": self.index_gen, "score_gen": self.score_gen}

    def reply(self, text: str, limit: int = TOP_K) -> str:
        """One JSON line with totals, status and hits."""
        asked = self.spark.createDataFrame([(0, self.root, text)], "qid int, root string, text string")
        status = self.spark.createDataFrame([tuple(self.status().values())], "root string, indexed int, scan_done boolean, unwatched int, root_lost boolean, index_gen long, score_gen long")
        entries = self.scored()
        return reply.replies(search.batch_search(entries, asked, limit), search.batch_totals(entries, asked), status, asked).first()["reply"]

    def decay(self, now: int) -> None:
        elapsed = now - self.last_decay
        if elapsed < DECAY_INTERVAL_SECS or self.half_life <= 0:
            return
        less = lambda df, c: stored(rank.decayed(df, c, elapsed, self.half_life))
        self._scored = None
        self.opens, self.edges, self.rank = less(self.opens, ["opens"]), less(self.edges, ["weight"]), less(self.rank, ["p", "r"])
        self.postings: DataFrame | None = None  # of every path that was ever known, in parts sorted by token
        self.parts, self._scored = 0, None
        self.lister, self.root_lost, self.last_save = lister, False, int(time.time())
        self.last_decay, self.changed, self.score_gen = now, True, self.score_gen + 1

    def forget(self) -> None:
        """Drop the history; the catalog stays."""
        self._scored = None
        self.opens, self.edges, self.rank = self.opens.limit(0), self.edges.limit(0), self.rank.limit(0)
        self.changed, self.score_gen = True, self.score_gen + 1

    def save(self) -> str | None:
        """Write a snapshot if anything changed since the last one."""
        if not self.changed:
            return None
        nodes = stored(snapshot.snapshot_nodes(self.scored(), self.opens))
        place = snapshot.save(self.folder, self.root, nodes, snapshot.snapshot_edges(nodes, self.edges), self.identity, last_decay=self.last_decay)
        self.changed = False
        return place
