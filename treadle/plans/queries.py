"""One query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions import paths, tokens
from treadle.operators import access, catalog, rank, reply, search, snapshot
from treadle.plans.blocks import ordinals
from treadle.plans.storage import stored, stored_sorted
from treadle.sources import tables as T
from treadle.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEEK_KEYS = ["/data/docs/fr", "/data/parts/Brand#2", "/data/web", "/zzz"]
DELETED = "/data/parts/Brand#12"
UNREADABLE = ["/data/parts/Brand#11", "/data/parts/Brand#3"]
PREFIX_PROBES = ["ri", "ring", "1", "csv", "Customer#0000", "é"]
PROBE_TEXTS = ["ring_1", "small ring.csv", "a.b", "Customer#00000001"]
WIDTHS = [60, 40, 24, 12]
DECAYS = [(3599.0, 1209600.0), (3600.0, 1209600.0), (-5.0, 1209600.0), (86400.0, 0.0), (1209600.0, 1209600.0)]
SAVED_AFTER = 100 * 86400.0
SCORED_TEXT = "item_1"
ROOTS = ["/data", "/home/é", "/"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- catalog


@query
def cat_entries(spark, sf):
    return T.entries(spark, sf).select("root", "path", "is_dir")


def hidden_rows(spark, sf) -> DataFrame:
    """Every file, and the same one under a hidden directory, and one with a hidden name."""
    own = T.files(spark, sf).select("root", "path")
    kinds = F.explode(F.array(F.col("path"), F.replace("path", F.lit("/data/"), F.lit("/data/.hidden/")), F.concat("path", F.lit("/.x"))))
    return own.select("root", kinds.alias("path"))


@query
def cat_visible(spark, sf):
    return catalog.visible_entries(hidden_rows(spark, sf))


@query
def cat_ordered(spark, sf):
    found = T.entries(spark, sf).select("root", "path", "is_dir")
    return ordinals(found, ["root"], ["path"], "place").orderBy("path")


@query
def cat_seek(spark, sf):
    own = search.live(T.entries(spark, sf)).select("path")
    return reduce(DataFrame.unionByName, [own.where(F.col("path") >= k).orderBy("path").limit(1).select(F.lit(k).alias("key"), "path") for k in SEEK_KEYS])


@query
def cat_upsert(spark, sf):
    return catalog.upsert(T.old_catalog(spark, sf), T.new_listing(spark, sf))


@query
def cat_lifecycle(spark, sf):
    found = T.events(spark, sf)
    return catalog.lifecycle(T.event_entries(found), found)


@query
def cat_dir_delete(spark, sf):
    """Deletes of directories, in order with creates and moves of files below them."""
    found = T.tree_events(spark, sf)
    return catalog.lifecycle(T.event_entries(found.where("not is_dir")), found)


@query
def cat_root_lost(spark, sf):
    found = T.lost_events(spark, sf)
    return catalog.status(catalog.lifecycle(T.event_entries(found.where("not is_dir")), found), found)


@query
def cat_delete_subtree(spark, sf):
    return catalog.delete_subtree(T.entries(spark, sf).select(*catalog.COLUMNS), DELETED)


@query
def cat_diff(spark, sf):
    return catalog.reconcile(T.old_catalog(spark, sf), T.new_listing(spark, sf))


@query
def cat_diff_unreadable(spark, sf):
    lost = spark.createDataFrame([(T.ROOT, d) for d in UNREADABLE], "root string, dir string")
    return catalog.reconcile(T.old_catalog(spark, sf), T.new_listing(spark, sf), lost)


# ---- scalar functions


def all_paths(spark, sf) -> DataFrame:
    return T.entries(spark, sf).select("root", "path")


@query
def fn_basename(spark, sf):
    return all_paths(spark, sf).select("path", paths.basename(F.col("path")).alias("name"))


@query
def fn_relpath(spark, sf):
    rel = lambda r: paths.relative(F.col("path"), r)
    return all_paths(spark, sf).select("path", rel(F.col("root")).alias("rel"), rel(F.lit("/data/docs")).alias("in_docs"), rel(F.lit("/")).alias("in_all"))


@query
def fn_relpath_ok(spark, sf):
    rel = F.explode(F.array(F.col("path"), F.expr("substr(path, 2)"), F.concat("path", F.lit("/..")), F.expr("replace(substr(path, 2), 'data/', 'data//')"), F.expr("concat('./', substr(path, 2))"), F.expr("concat(substr(path, 2), '/..x')")))
    return all_paths(spark, sf).select(rel.alias("rel")).distinct().select("rel", paths.relative_ok(F.col("rel")).alias("ok"))


@query
def fn_path_join(spark, sf):
    name = paths.basename(F.col("path"))
    return all_paths(spark, sf).select("path", paths.joined(F.col("root"), name).alias("in_root"), paths.joined(F.lit("/"), name).alias("in_top"))


@query
def fn_normalize(spark, sf):
    raw = F.explode(F.array(F.col("path"), F.concat("path", F.lit("/")), F.concat("path", F.lit("///")), F.lit("/"), F.lit("///")))
    return all_paths(spark, sf).select(raw.alias("raw")).distinct().select("raw", paths.normalized(F.col("raw")).alias("path"))


@query
def fn_abbreviate(spark, sf):
    return all_paths(spark, sf).select("path", *[paths.abbreviated(paths.relative(F.col("path"), F.col("root")), w).alias(f"w{w}") for w in WIDTHS])


# ---- tokens


@query
def tok_segments(spark, sf):
    name = paths.basename(F.col("path"))
    return all_paths(spark, sf).select("path", F.posexplode(tokens.segments(name)).alias("place", "segment"))


@query
def tok_suffixes(spark, sf):
    segment = F.explode(tokens.segments(paths.basename(F.col("path"))))
    return all_paths(spark, sf).select(segment.alias("segment")).distinct().select("segment", F.explode(tokens.suffixes(F.col("segment"))).alias("suffix")).where(F.octet_length("suffix") >= 2)


def all_postings(spark, sf) -> DataFrame:
    return tokens.postings(T.entries(spark, sf))


@query
def tok_postings(spark, sf):
    return all_postings(spark, sf)


@query
def tok_count(spark, sf):
    return all_postings(spark, sf).agg(F.count("*").alias("pairs"))


@query
def tok_prefix_postings(spark, sf):
    counts = [F.count_if(F.startswith(F.col("token"), F.lit(p))).alias("n") for p in PREFIX_PROBES]
    row = all_postings(spark, sf).agg(F.array(*[F.struct(F.lit(p).alias("prefix"), n.alias("postings")) for p, n in zip(PREFIX_PROBES, counts, strict=True)]).alias("x"))
    return row.select(F.inline("x"))


@query
def tok_probe(spark, sf):
    held = all_postings(spark, sf)
    probes = [(t, search.probe_counts(held, t)) for t in PROBE_TEXTS]
    best = lambda df: df.agg(F.min(F.struct("postings", -F.octet_length("segment"), "place", "segment")).alias("b"))
    return reduce(DataFrame.unionByName, [best(df).select(F.lit(t).alias("text"), F.col("b.segment").alias("segment"), F.col("b.postings").alias("postings")) for t, df in probes])


# ---- search


@query
def search_classify(spark, sf):
    rows = T.query_rows(spark)
    text, root = F.col("text"), F.col("root")
    kind = paths.query_kind(text)
    return rows.select("qid", kind.alias("kind"), F.when(kind == "prefix", paths.query_prefix(text, root)).alias("prefix"))


def hits(text: str, limit: int = 20) -> Query:
    return lambda spark, sf: reply.best_first(search.search(T.entries(spark, sf), T.ROOT, text, limit))


SEARCHES = {
    "search_root": "", "search_prefix_abs": "/data/docs/fr", "search_prefix_rel": "parts/", "search_prefix_byte": "p",
    "search_token_plain": "ring", "search_token_cross": "ring_1", "search_token_short": "a.", "search_token_unicode": "é",
}
QUERIES.update({name: hits(text) for name, text in SEARCHES.items()})
QUERIES["search_limit"] = hits("ring", 5)


@query
def search_token_indexed(spark, sf):
    held = stored_sorted(all_postings(spark, sf), "token")  # an engine keeps them; a probe reads the row groups that hold its prefix
    found = search.indexed_matches(T.entries(spark, sf), held, T.ROOT, "ring_1")
    return reply.best_first(search.top(found))


@query
def search_tiers(spark, sf):
    rows = spark.createDataFrame(T.TIER_ROWS, "path string").unionByName(T.files(spark, sf).select("path"))
    texts = F.explode(F.array(*[F.lit(t) for t in [*T.TIER_TEXTS, "ring", ".c"]]))
    found = rows.select("path", texts.alias("text")).distinct().where(F.contains(paths.basename(F.col("path")), F.col("text")))
    return found.select("path", "text", paths.tier(F.col("path"), F.col("text")).alias("tier"))


@query
def search_totals(spark, sf):
    return search.batch_totals(T.entries(spark, sf), T.query_rows(spark))


@query
def search_batch(spark, sf):
    return search.batch_search(T.entries(spark, sf), T.query_rows(spark))


# ---- access


def eligible_events(spark, sf) -> DataFrame:
    return access.eligible(T.events(spark, sf))


@query
def acc_eligible(spark, sf):
    return eligible_events(spark, sf).select("event_id", "root", "path", "kind")


@query
def acc_move_in(spark, sf):
    """Files moved in are edited, directories aren't opened, and what lies in a deleted directory isn't either."""
    return access.eligible(T.tree_events(spark, sf)).select("event_id", "root", "path", "kind")


@query
def acc_gaps(spark, sf):
    return access.with_gaps(eligible_events(spark, sf)).select("event_id", "root", F.round("gap", 6).alias("gap"))


@query
def acc_gated(spark, sf):
    """All events as opens of one root, where bursts occur."""
    one = T.events(spark, sf).select("event_id", "ts", F.lit("/events").alias("root"), "path", F.lit("open").alias("kind"), "is_dir")
    return access.gated(one).select("event_id", F.round("gap", 6).alias("gap"))


@query
def acc_sessions(spark, sf):
    return access.sessions(eligible_events(spark, sf))


def passed_events(spark, sf) -> DataFrame:
    return access.gated(eligible_events(spark, sf))


@query
def acc_transitions(spark, sf):
    return access.transitions(passed_events(spark, sf)).select("root", "event_id", "src", "dst")


def counted_events(spark, sf) -> DataFrame:
    return access.counted(access.candidates(stored(passed_events(spark, sf))))


@query
def acc_counted(spark, sf):
    return counted_events(spark, sf).select("root", "kind", "event_id", "src", "dst")


@query
def acc_opens(spark, sf):
    return access.visit_weights(counted_events(spark, sf))


@query
def acc_edges(spark, sf):
    return access.edge_weights(counted_events(spark, sf))


# ---- graph and rank


def graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    counts = stored(counted_events(spark, sf))
    return stored(access.visit_weights(counts)), stored(access.edge_weights(counts))


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Counted rows of events up to the middle id, and the others."""
    counts = stored(counted_events(spark, sf))
    middle = T.events(spark, sf).agg(F.max("event_id")).first()[0] // 2
    return counts.where(F.col("event_id") <= middle), counts.where(F.col("event_id") > middle)


@query
def graph_outweight(spark, sf):
    return rank.out_weights(graph(spark, sf)[1])


@query
def graph_apply(spark, sf):
    first, second = halves(spark, sf)
    return rank.apply_deltas(access.edge_weights(first), access.edge_weights(second))


@query
def graph_stats(spark, sf):
    opens, edges = graph(spark, sf)
    nodes = rank.with_targets(opens, edges).groupBy("root").agg(F.count("*").alias("nodes"), F.sum("opens").alias("opens"))
    return nodes.join(edges.groupBy("root").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")), "root")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query
def pr_step(spark, sf):
    opens, edges = graph(spark, sf)
    start = rank.start(rank.with_targets(opens, edges))
    return rounded(rank.pushed(start, rank.moves(start, edges)), "p", "r", digits=6)


@query
def pr_full(spark, sf):
    return rounded(rank.full_rank(*graph(spark, sf)).select("root", "path", "p"), "p")


@query
def pr_incremental(spark, sf):
    """Ranked after half of the events, then brought up to date."""
    first, second = halves(spark, sf)
    opens, edges = access.visit_weights(first), access.edge_weights(first)
    settled = stored(rank.full_rank(opens, edges))
    opens, edges = rank.apply_opens(opens, access.visit_weights(second)), rank.apply_deltas(edges, access.edge_weights(second))
    return rounded(rank.incremental_rank(opens, settled, stored(edges), epsilon=0.0).select("root", "path", "p"), "p")


def scored_entries(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries with score, opens, edges) of the events' files."""
    opens, edges = graph(spark, sf)
    found = T.events(spark, sf)
    own = catalog.lifecycle(T.event_entries(found), found)
    return stored(rank.synced(own, rank.full_rank(opens, edges))), opens, edges


@query
def rank_sync(spark, sf):
    return rounded(scored_entries(spark, sf)[0].select("root", "path", "score"), "score")


@query
def rank_decay(spark, sf):
    edges = graph(spark, sf)[1]
    parts = [rank.decayed(edges, ["weight"], e, h).select(F.lit(e).alias("elapsed"), F.lit(h).alias("half_life"), "root", "src", "dst", "weight") for e, h in DECAYS]
    return rounded(reduce(DataFrame.unionByName, parts), "weight", digits=9)


@query
def rank_forget(spark, sf):
    opens, edges = graph(spark, sf)
    return rank.forgotten(rank.start(rank.with_targets(opens, edges)))


@query
def search_ranked(spark, sf):
    """The flagship: a substring query over all roots' files, best of tier, rank and path."""
    entries = scored_entries(spark, sf)[0]
    found = reduce(DataFrame.unionByName, [search.token_matches(entries, f"/events/r{k}", SCORED_TEXT) for k in range(4)])
    return reply.best_first(search.top(rounded(found, "score")))


# ---- snapshots


def saved(spark, sf) -> tuple[DataFrame, DataFrame]:
    entries, opens, edges = scored_entries(spark, sf)
    everything = T.entries(spark, sf).select("root", "path", "is_dir", "dead", "score").unionByName(entries.select("root", "path", "is_dir", "dead", "score"))
    nodes = snapshot.snapshot_nodes(everything, opens)
    return nodes, snapshot.snapshot_edges(nodes, rank.decayed(edges, ["weight"], SAVED_AFTER, 14 * 86400.0))


@query
def snap_nodes(spark, sf):
    return rounded(saved(spark, sf)[0].select("root", "id", "rel", "pgrk", "opens", "is_dir"), "pgrk")


@query
def snap_edges(spark, sf):
    return rounded(saved(spark, sf)[1], "weight", digits=9)


@query
def snap_size(spark, sf):
    return snapshot.snapshot_bytes(*saved(spark, sf))


@query
def snap_validate(spark, sf):
    nodes = spark.createDataFrame([("/r", k, *r) for k, r in enumerate(T.SNAPSHOT_ROWS)], snapshot.NODE_SCHEMA)
    edges = spark.createDataFrame([("/r", *e) for e in T.SNAPSHOT_EDGES], snapshot.EDGE_SCHEMA)
    counts = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"))
    own = snapshot.node_faults(nodes).select(F.lit("node").alias("part"), F.col("rel").alias("what"), "ok")
    of = snapshot.edge_faults(edges, counts).select(F.lit("edge").alias("part"), F.concat_ws(" ", "src", "dst").alias("what"), "ok")
    return own.unionByName(of)


@query
def snap_adopt(spark, sf):
    rows = lambda r: spark.createDataFrame(r, "root string, dev long, ino long, btime long")
    return snapshot.adoptions(rows(T.ROOTS), rows(T.SAVED), rows(T.REACHABLE))


@query
def snap_name(spark, sf):
    return spark.createDataFrame([(r, snapshot.snapshot_name(r)) for r in ROOTS], "root string, name string")


@query
def status_row(spark, sf):
    found = T.events(spark, sf)
    return catalog.status(catalog.lifecycle(T.event_entries(found), found), found)


# ---- replies


@query
def reply_json(spark, sf):
    entries, asked = T.entries(spark, sf), T.query_rows(spark)
    status = catalog.status(entries, T.events(spark, sf))
    return reply.replies(search.batch_search(entries, asked), search.batch_totals(entries, asked), status, asked)


@query
def reply_parse(spark, sf):
    lines = reply_json(spark, sf).select(F.col("reply").alias("line"))
    return reply.parsed(lines).select("ok", F.col("reply.total").alias("total"), F.size("reply.hits").alias("hits"), F.col("reply.root").alias("root"))


# ---- streams


@query
def stream_events(spark, sf):
    return live.collected(live.table_stream(spark, sf))


@query
def stream_apply(spark, sf):
    return live.applied(live.table_stream(spark, sf), T.event_entries(T.events(spark, sf)))


@query
def stream_counted(spark, sf):
    return live.collected(live.counted_stream(live.table_stream(spark, sf))).select("root", "kind", "event_id", "src", "dst")


@query
def stream_rank(spark, sf):
    return rounded(live.ranked(live.table_stream(spark, sf)).select("root", "path", "p"), "p")




def queries() -> dict[str, Query]:
    return dict(QUERIES)
