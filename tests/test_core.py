"""Micro-fixtures for the rules that the generated tables don't reach, and properties that relate operators."""

import json
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from treadle import api
from treadle.functions import paths, tokens
from treadle.operators import access, catalog, rank, reply, search, snapshot
from treadle.plans import blocks
from treadle.plans.oracle import oracle_sql
from treadle.plans.queries import queries
from treadle.sources import binary_snapshot, tree
from treadle.streaming import live

START = datetime(2024, 1, 1)


def entries(spark, names, root="/r", score=0.0):
    return spark.createDataFrame([(root, f"{root}/{n}" if n else root, n.endswith("/") if n else True, False, score) for n in names], "root string, path string, is_dir boolean, dead boolean, score double").withColumn("path", paths.normalized(F.col("path")))


def events(spark, rows, root="/r"):
    """rows: (seconds, kind, name)"""
    made = [(k, START + timedelta(seconds=s), root, f"{root}/{n}", kind, False) for k, (s, kind, n) in enumerate(rows)]
    return spark.createDataFrame(made, "event_id long, ts timestamp_ntz, root string, path string, kind string, is_dir boolean")


def counted(spark, rows, known=None):
    found = events(spark, rows)
    own = catalog.lifecycle(entries(spark, known or sorted({n for _, _, n in rows})).select(*catalog.COLUMNS), found.limit(0))
    got = access.counted(access.candidates(access.gated(access.eligible(found, own)))).orderBy("event_id", "kind").collect()
    return [(r["event_id"], r["kind"], r["src"][3:], r["dst"] and r["dst"][3:]) for r in got]


# ---- search


def names(df):
    return [r["path"] for r in df.collect()]


def test_lengths_are_in_bytes(spark):
    own = entries(spark, ["a", "é", "日.txt", "ab.ab", "xé"])
    assert names(search.search(own, "/r", "a")) == ["/r/a", "/r/ab.ab"]
    assert names(search.search(own, "/r", "é")) == ["/r/é", "/r/xé"]
    assert names(search.search(own, "/r", "日")) == ["/r/日.txt"]


def test_tiers_and_order(spark):
    own = entries(spark, ["pagerank.c", "page-rank.c", "rank.cpp", "rank.c", "a.c", "b.a.c"])
    assert names(search.search(own, "/r", "rank.c")) == ["/r/rank.c", "/r/rank.cpp", "/r/page-rank.c", "/r/pagerank.c"]
    got = {r["path"]: r["tier"] for r in search.search(own, "/r", ".c").collect()}
    assert got["/r/a.c"] == 3 and got["/r/rank.cpp"] == 3
    better = own.withColumn("score", F.when(F.col("path") == "/r/pagerank.c", 9.0).otherwise(F.col("score")))
    assert names(search.search(better, "/r", "rank.c"))[-1] == "/r/pagerank.c"


def test_root_listing(spark):
    own = entries(spark, ["", "sub/", "sub/x", "sub.txt", "sub-2"])
    assert names(search.search(own, "/r", "")) == ["/r/sub", "/r/sub-2", "/r/sub.txt"]
    assert names(search.search(own, "/r", "sub/")) == ["/r/sub/x"]
    assert names(search.search(own, "/r", "/r/sub")) == ["/r/sub", "/r/sub-2", "/r/sub.txt", "/r/sub/x"]


def test_limit_and_total(spark):
    own = entries(spark, [f"file{k:03}" for k in range(50)])
    assert search.search(own, "/r", "file", 99).count() == 20 and search.search(own, "/r", "file", 3).count() == 3
    assert search.total(own, "/r", "file") == 50
    dead = own.withColumn("dead", F.col("path").endswith("7"))
    assert search.total(dead, "/r", "file") == 45


def test_indexed_search_equals_scan(spark):
    rng = random.Random(1)
    own = entries(spark, sorted({"".join(rng.choices("ab é日.-_", k=rng.randint(1, 8))).strip() or "x" for _ in range(150)})).cache()
    held = tokens.postings(own).cache()
    for _ in range(12):
        text = "".join(rng.choices("ab é日.-_", k=rng.randint(2, 4)))
        assert sorted(names(search.indexed_matches(own, held, "/r", text))) == sorted(names(search.token_matches(own, "/r", text)))


def test_tokens(spark):
    row = spark.createDataFrame([("ab.ab",), ("é-x",), ("..",), ("a b",)], "n string").select(tokens.tokens(F.col("n")).alias("t")).collect()
    assert [sorted(r["t"]) for r in row] == [["ab", "ab.ab"], ["é", "é-x"], [".."], ["a b"]]


def repeated_pages(spark, tmp_path):
    """A folder of tables in which two pages have one address and a third one's directory is a page, too."""
    own = {name: f"/root/testdata/sf0.001/{name}.parquet" for name in ("part", "customer", "supplier", "nation", "documents")}
    for name, path in own.items():
        (tmp_path / f"{name}.parquet").symlink_to(path)
    rows = [(1, "https://a.b/ring_1", ""), (2, "https://a.b/ring_1/", ""), (3, "https://a.b/ring_1/x1", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def by_sql(folder, name):
    """What the query's SQL returns, sorted."""
    con = duckdb.connect()
    for t in ("part", "customer", "supplier", "nation", "documents", "pages"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS FROM read_parquet('{path}')")
    return sorted(con.execute(oracle_sql()[name]).fetchall())


def test_count_of_postings_with_repeated_paths(spark, tmp_path):
    folder = repeated_pages(spark, tmp_path)
    assert sorted(map(tuple, queries()["tok_count"](spark, folder).collect())) == by_sql(folder, "tok_count")


def test_postings_of_repeated_paths(spark, tmp_path):
    folder = repeated_pages(spark, tmp_path)
    got = sorted(map(tuple, queries()["tok_postings"](spark, folder).collect()))
    assert got == by_sql(folder, "tok_postings")
    assert [t for t, _, path in got if path == "/data/web/a.b/ring_1"] == ["ing", "ng", "ring", "ring_1"]


def test_prefix_counts_of_repeated_paths(spark, tmp_path):
    folder = repeated_pages(spark, tmp_path)
    got = sorted(map(tuple, queries()["tok_prefix_postings"](spark, folder).collect()))
    assert got == by_sql(folder, "tok_prefix_postings")


def spaced_texts(spark, tmp_path):
    """A folder of tables in which texts have spaces of all kinds before, in and after their first words."""
    own = {name: f"/root/testdata/sf0.001/{name}.parquet" for name in ("part", "customer", "supplier", "nation", "pages")}
    for name, path in own.items():
        (tmp_path / f"{name}.parquet").symlink_to(path)
    wide = "\u00a0\u1680\u2000\u2005\u200a\u202f\u205f\u3000"
    texts = [f"{a}ring{b}" for a in [*wide, " ", " \u3000 ", "\t", "\u2028", "\n", "\u3000\n"] for b in ("", " x", "\u3000", "\u3000 ", " \u3000", "\u3000x", "\u3000 x", "\u3000\n")]
    texts += ["", " ", wide, None, f"{wide}é{wide}1", "csv" * 90 + wide, wide * 50 + "csv", "é" + wide * 50, "é" + wide * 20 + " 1", "é" + " \n" * 100_000]
    rows = [(k, t, "en", "web", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_postings_of_spaced_texts(spark, tmp_path):
    folder = spaced_texts(spark, tmp_path)
    got = sorted(map(tuple, queries()["tok_postings"](spark, folder).collect()))
    assert got == by_sql(folder, "tok_postings")
    assert ("ring-0.txt", "/data", "/data/docs/en/web/ring-0.txt") in got


def test_prefix_counts_of_spaced_texts(spark, tmp_path):
    folder = spaced_texts(spark, tmp_path)
    got = sorted(map(tuple, queries()["tok_prefix_postings"](spark, folder).collect()))
    assert got == by_sql(folder, "tok_prefix_postings")


# ---- access


def test_gate_session_and_clock(spark):
    rows = [(0, "open", "a"), (0.4, "open", "b"), (0.9, "open", "c"), (600.9, "open", "d"), (1201.0, "open", "e"), (1800, "edit", "f"), (2300, "open", "g")]
    got = counted(spark, rows)
    assert got == [
        (0, "open", "a", None), (2, "edge", "a", "c"), (2, "open", "c", None), (3, "edge", "c", "d"), (3, "open", "d", None),
        (4, "open", "e", None), (5, "edit", "f", None), (6, "edge", "e", "g"), (6, "open", "g", None),
    ]


def test_unknown_paths_leave_the_clock_alone(spark):
    rows = [(0, "open", "a"), (0.3, "open", "nowhere"), (0.6, "open", "b")]
    assert (2, "edge", "a", "b") in counted(spark, rows, known=["a", "b"])


def test_repeats(spark):
    rows = [(1, "open", "a"), (60.9, "open", "a"), (61.5, "open", "a"), (70, "open", "b"), (80, "open", "a"), (90, "open", "b")]
    got = counted(spark, rows)
    assert [x for x in got if x[1] == "open"] == [(0, "open", "a", None), (2, "open", "a", None), (3, "open", "b", None)]
    assert [x[2:] for x in got if x[1] == "edge"] == [("a", "b"), ("b", "a")]


def test_only_eight_are_remembered(spark):
    rows = [(k + 1, "open", f"f{k}") for k in range(9)] + [(10, "open", "f0"), (11, "open", "f8")]
    opens = [x[0] for x in counted(spark, rows) if x[1] == "open"]
    assert opens == [*range(9), 9]


def test_lifecycle(spark):
    rows = [(0, "open", "a"), (1, "delete", "a"), (2, "open", "a"), (3, "create", "a"), (100, "open", "a"), (200, "create", "new"), (201, "move_out", "b")]
    assert [x[0] for x in counted(spark, rows, known=["a", "b"])] == [0, 4]
    after = {r["path"]: r["dead"] for r in catalog.lifecycle(entries(spark, ["a", "b"]).select(*catalog.COLUMNS), events(spark, rows)).collect()}
    assert after == {"/r/a": False, "/r/b": True, "/r/new": False}


def test_directories_take_what_is_below_along(spark):
    rows = [(0, "move_in", "a"), (10, "open", "d", True), (20, "delete", "d", True), (30, "open", "d/x"), (40, "create", "d/x"), (50, "open", "d/x"), (60, "open", "dx"), (70, "root_gone", ""), (80, "open", "dx")]
    made = [(k, START + timedelta(seconds=s), "/r", f"/r/{n}" if n else "/r", kind, bool(more)) for k, (s, kind, n, *more) in enumerate(rows)]
    found = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, root string, path string, kind string, is_dir boolean")
    own = entries(spark, ["", "d/", "d/x", "d/y", "dx"]).select(*catalog.COLUMNS)
    assert [(r["event_id"], r["kind"]) for r in access.eligible(found, own).orderBy("event_id").collect()] == [(0, "edit"), (5, "open"), (6, "open")]
    some = found.where("event_id < 7")
    dead = {r["path"]: r["dead"] for r in catalog.lifecycle(own, some).collect()}
    assert dead == {"/r": False, "/r/a": False, "/r/d": True, "/r/d/x": False, "/r/d/y": True, "/r/dx": False}
    assert all(r["dead"] for r in catalog.lifecycle(own, found).collect())
    alive, heard = live.Alive(), []
    for k, (_, kind, name, *more) in enumerate(rows):
        alive.take(kind, "/r", f"/r/{name}", bool(more), [k, k])
        if kind in ("open", "move_in") and not more and alive(f"/r/{name}"):
            heard.append(k)
    assert heard == [0, 5, 6]
    assert catalog.status(catalog.lifecycle(own, found), found).first()["root_lost"]


def plain_counts(rows):
    """All of it in one loop, for events of one root whose files are all alive before."""
    last_at, last_path, dead, out = None, None, set(), []
    rings = {k: access.RepeatRing() for k in ("open", "edit", "edge")}
    for k, (s, kind, n) in enumerate(rows):
        if kind in ("create", "delete"):
            (dead.discard if kind == "create" else dead.add)(n)
            continue
        if n in dead:
            continue
        gap, last_at = 601 if last_at is None else s - last_at, s
        if gap < 0.5:
            continue
        if rings[kind].counts(n, s):
            out.append((k, kind, n, None))
        if kind == "open":
            src, last_path = (last_path if gap <= 600 else None), n
            if src and src != n and rings["edge"].counts((src, n), s):
                out.append((k, "edge", src, n))
    return sorted(out, key=lambda x: x[:2])


def busy_rows(seed, n=400):
    rng = random.Random(seed)
    at, rows = 10.0, []
    for _ in range(n):
        at += rng.choice([0.25, 0.5, 1, 2, 5, 30, 61, 700, 4000])
        rows.append((at, rng.choice(["open"] * 6 + ["edit", "create", "delete"]), f"f{rng.randint(0, 11)}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_one_loop(spark, seed):
    rows = busy_rows(seed)
    assert counted(spark, rows, known=[f"f{k}" for k in range(12)]) == plain_counts(rows)


def test_blocks_equal_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("ab"), t, rng.choice([None, t])) for t in range(200)], "k string, t long, v long").cache()
    plain = Window.partitionBy("k").orderBy("t")
    own = blocks.last_before(df, ["k"], F.floor(F.col("t") / 7), ["t"], F.col("v"), "got").withColumn("want", F.last("v", True).over(plain.rowsBetween(Window.unboundedPreceding, -1)))
    assert own.where("not (got <=> want)").isEmpty() and own.count() == 200
    own = blocks.running_sum(df, ["k"], F.floor(F.col("t") / 7), ["t"], F.coalesce("v", F.lit(0)), "got").withColumn("want", F.sum(F.coalesce("v", F.lit(0))).over(plain))
    assert own.where("got <> want").isEmpty()
    own = blocks.ordinals(df, ["k"], ["t"], "got").withColumn("want", F.row_number().over(plain) - 1)
    assert own.where("got <> want").isEmpty() and own.count() == 200


# ---- rank


def graph(spark):
    nodes = spark.createDataFrame([("/r", n, v) for n, v in [("a", 3.0), ("b", 1.0), ("c", 0.0), ("d", 2.0), ("hub", 5.0)]], "root string, path string, opens double")
    edges = spark.createDataFrame([("/r", s, d, w) for s, d, w in [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("hub", "a", 3.0), ("hub", "d", 1.0)]], "root string, src string, dst string, weight double")
    return nodes, edges


def exact(nodes, edges, n=60):
    v = {r["path"]: r["opens"] for r in nodes.collect()}
    rows = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
    total = {}
    for s, _, w in rows:
        total[s] = total.get(s, 0) + w
    p, r = dict.fromkeys(v, 0.0), dict(v)
    for _ in range(n):
        got = dict.fromkeys(v, 0.0)
        for s, d, w in rows:
            got[d] += 0.5 * r[s] * w / total[s]
        p = {k: p[k] + 0.5 * r[k] for k in p}
        r = got
    return p


def test_rank_is_the_series_and_dangling_mass_is_lost(spark):
    nodes, edges = graph(spark)
    got = {r["path"]: r["p"] for r in rank.full_rank(nodes, edges).collect()}
    want = exact(nodes, edges)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert sum(got.values()) < sum(r["opens"] for r in nodes.collect())


def test_incremental_equals_full(spark):
    nodes, edges = graph(spark)
    settled = rank.full_rank(nodes, edges)
    more = spark.createDataFrame([("/r", "d", "c", 2.0), ("/r", "a", "d", 1.0)], edges.schema)
    opens = rank.apply_opens(nodes, spark.createDataFrame([("/r", "c", 4.0)], nodes.schema))
    after = rank.apply_deltas(edges, more)
    got = {r["path"]: r["p"] for r in rank.incremental_rank(opens, settled, after).collect()}
    want = exact(opens, after)
    assert all(abs(got[k] - want[k]) < 2e-4 for k in want)
    fine = {r["path"]: r["p"] for r in rank.incremental_rank(opens, settled, after, n=12, epsilon=1e-9).collect()}
    assert fine.keys() == want.keys() and all(abs(fine[k] - want[k]) < 5e-3 for k in want)


def test_only_active_files_are_touched(spark):
    state = spark.createDataFrame([("/r", k, 1.0, r) for k, r in (("a", 1.0), ("b", 1e-6), ("c", 0.0), ("d", 1e-6))], "root string, path string, p double, r double")
    edges = spark.createDataFrame([("/r", "a", "b", 1.0), ("/r", "d", "c", 1.0)], "root string, src string, dst string, weight double")
    got = {r["path"]: (r["p"], r["r"]) for r in rank.active_rounds(state, edges, 1, 1e-4).collect()}
    assert got == {"a": (1.5, 0.0), "b": (1.0, 1e-6 + 0.5), "c": (1.0, 0.0), "d": (1.0, 1e-6)}
    got = {r["path"]: r["p"] for r in rank.active_rounds(state, edges, 20, 1e-4).collect()}
    assert got["b"] == 1.0 + 0.5 * (1e-6 + 0.5) and got["d"] == 1.0


def test_decay(spark):
    nodes, edges = graph(spark)
    cases = spark.createDataFrame([(3599.0, 1e6), (3600.0, 3600.0), (-5.0, 1e6), (1e5, 0.0)], "e double, h double")
    assert [r[0] for r in cases.select(rank.decay_factor(F.col("e"), F.col("h"))).collect()] == [1.0, 0.5, 1.0, 1.0]
    small = rank.full_rank(rank.decayed(nodes, ["opens"], 7200, 3600), rank.decayed(edges, ["weight"], 7200, 3600))
    pairs = small.withColumnRenamed("p", "q").join(rank.decayed(rank.full_rank(nodes, edges), ["p"], 7200, 3600), ["root", "path"])
    assert pairs.where(F.abs(F.col("p") - F.col("q")) > 1e-9).isEmpty()
    assert rank.forgotten(rank.start(nodes)).agg(F.sum("r") + F.sum("p")).first()[0] == 0


# ---- snapshots, replies, sources


def test_snapshot_round_trip(spark, tmp_path):
    nodes, edges = graph(spark)
    opens = nodes.withColumn("path", F.concat(F.lit("/r/"), "path"))
    links = edges.select("root", F.concat(F.lit("/r/"), "src").alias("src"), F.concat(F.lit("/r/"), "dst").alias("dst"), "weight")
    own = entries(spark, ["", "a", "b", "c", "d", "hub"], score=1.5).withColumn("dead", F.col("path") == "/r/d")
    saved = snapshot.snapshot_nodes(own, opens)
    ends = snapshot.snapshot_edges(saved, links)
    assert [(r["id"], r["rel"]) for r in saved.orderBy("id").collect()] == list(enumerate(["", "a", "b", "c", "hub"]))
    assert ends.count() == 4
    snapshot.save(str(tmp_path), "/r", saved, ends)
    again, links_again, head = snapshot.load(spark, str(tmp_path), "/r")
    assert sorted(r["path"] for r in again.collect()) == ["/r", "/r/a", "/r/b", "/r/c", "/r/hub"] and links_again.count() == 4 and head["root"] == "/r"
    assert snapshot.load(spark, str(tmp_path), "/other") is None
    bad = saved.withColumn("pgrk", F.lit(float("nan")))
    snapshot.save(str(tmp_path), "/r", bad, ends)
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path), "/r")
    assert snapshot.clear_all(spark, str(tmp_path))


def test_binary_snapshot(spark, tmp_path):
    nodes, edges = [("", 0.5, 1.0, True), ("a/é", 0.0, 2.0, False)], [(0, 1, 0.25)]
    data = binary_snapshot.encode("/r", nodes, edges, (1, 2, -3), 99)
    assert binary_snapshot.decode(data) == {"root": "/r", "identity": (1, 2, -3), "nodes": nodes, "edges": edges, "last_decay": 99}
    size = snapshot.MAGIC_BYTES + snapshot.HEADER_BYTES + snapshot.TAIL_BYTES + 2 + 2 * snapshot.NODE_BYTES + len("a/é".encode()) + snapshot.EDGE_BYTES
    assert len(data) == size
    for broken in (data[:-1], data + b"x", b"XX10" + data[4:], binary_snapshot.encode("/r", [("a//b", 0, 0, False)], []), binary_snapshot.encode("/r", nodes, [(0, 2, 1.0)]), binary_snapshot.encode("/r", [("a", float("nan"), 0, False)], [])):
        with pytest.raises(ValueError):
            binary_snapshot.decode(broken)
    (tmp_path / "x.bin").write_bytes(data)
    assert binary_snapshot.read_nodes(spark, str(tmp_path)).count() == 2 and binary_snapshot.read_edges(spark, str(tmp_path)).first()["weight"] == 0.25


def test_tree_source(spark, tmp_path):
    for d in ("sub/deep", ".git", "sub/.cache"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("a.txt", ".hidden", "sub/b", "sub/deep/c", ".git/x", "sub/.cache/y"):
        (tmp_path / f).write_text("")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    found, unreadable = tree.listing(spark, str(tmp_path))
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in found.collect()) == [".", "a.txt", "sub", "sub/b", "sub/deep", "sub/deep/c"]
    assert unreadable.isEmpty()


def test_visible_looks_below_the_root_only(spark):
    df = spark.createDataFrame([("/home/.x", "/home/.x/a"), ("/home/.x", "/home/.x/.a"), ("/home/.x", "/home/.x/a/.b/c")], "root string, path string")
    assert names(catalog.visible_entries(df)) == ["/home/.x/a"]


def test_replies(spark):
    good = {"total": 1, "root": "/r", "hits": [{"path": "/r/a\"\\\u0001", "score": 1.25, "is_dir": False}]}
    lines = [
        json.dumps(good), json.dumps(dict(reversed(good.items()))), json.dumps(good | {"more": 1}), "{}", "[]", "nonsense", json.dumps(good | {"total": "x"}),
        json.dumps(good | {"hits": good["hits"] * 21}), json.dumps(good | {"hits": [{"path": "a", "size": 1}]}), json.dumps(good) + "x", json.dumps({"scan_done": True}),
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = [r["ok"] for r in reply.parsed(df).orderBy("k").collect()]
    assert got == [True, True, False, False, False, False, False, False, False, False, True]
    own = entries(spark, ['q"\\', "other"], score=0.5)
    asked = spark.createDataFrame([(0, "/r", 'q"'), (1, "/r", "none")], "qid int, root string, text string")
    status = catalog.status(own, events(spark, [(0, "create", "other")]))
    out = [json.loads(r["reply"]) for r in reply.replies(search.batch_search(own, asked), search.batch_totals(own, asked), status, asked).orderBy("qid").collect()]
    assert list(out[0]) == reply.MEMBERS and out[0]["hits"] == [{"path": '/r/q"\\', "score": 0.5, "is_dir": False}]
    assert out[1]["total"] == 0 and out[1]["hits"] == []


def test_paths(spark):
    rel = ["", "a", "a/..f", "/a", "a//b", "./a", "a/..", "a/"]
    df = spark.createDataFrame([(r,) for r in rel], "rel string").select(paths.relative_ok(F.col("rel")).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, True, True, False, False, False, False, False]
    assert paths.fnv1a_64("") == "cbf29ce484222325" and paths.fnv1a_64("a") == "af63dc4c8601ec8c"
    short = spark.range(1).select(*[paths.abbreviated(F.lit("one/two/three/name.txt"), w) for w in (30, 21, 16, 10, 6)]).first()
    assert list(short) == ["one/two/three/name.txt", "one/…/three/name.txt", "…/three/name.txt", "…/name.txt", "name.…"]


# ---- streams and the engine


def test_batches_equal_one_run(spark, tmp_path):
    rows = busy_rows(5, 300)
    found = events(spark, rows)
    raw = found.select("event_id", "ts", F.lit(4).cast("long").alias("user_id"), F.when(F.col("kind") == "open", "click").when(F.col("kind") == "edit", "purchase").when(F.col("kind") == "create", "signup").otherwise("error").alias("event_type"), F.lit(0.0).alias("value"), F.concat(F.lit('{"k": '), F.regexp_extract("path", "[0-9]+", 0), F.lit("}")).alias("props"))
    for k in range(3):
        raw.where(F.col("event_id").between(k * 100, k * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            f.rename(tmp_path / "all" / f"{k}.parquet")
            os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = live.event_stream(spark, str(tmp_path / "all"), files_per_batch=1)
    got = live.collected(live.counted_stream(stream)).orderBy("event_id", "kind").collect()
    assert [(r["event_id"], r["kind"], r["src"].replace("/events/r0/item_", "f").replace(".log", ""), r["dst"] and r["dst"].replace("/events/r0/item_", "f").replace(".log", "")) for r in got] == plain_counts(rows)
    whole = access.counted(access.candidates(access.gated(access.eligible(live.bound(spark.read.parquet(str(tmp_path / "all")))))))
    want = {r["path"]: r["p"] for r in rank.full_rank(access.visit_weights(whole), access.edge_weights(whole)).collect()}
    ranked = {r["path"]: r["p"] for r in live.ranked(live.event_stream(spark, str(tmp_path / "all"), files_per_batch=1)).collect()}
    assert ranked.keys() == want.keys() and all(abs(ranked[k] - want[k]) < 1e-4 for k in want)


def test_streams_go_on_from_their_folder(spark, tmp_path):
    rows = [(0, "create", "a"), (1, "delete", "b"), (2, "delete", "a"), (3, "create", "c")]
    own = entries(spark, ["a", "b"]).select(*catalog.COLUMNS)
    found = events(spark, rows)
    place, folder = str(tmp_path / "place"), tmp_path / "in"
    after = []
    for k in range(2):
        found.where(F.floor(F.col("event_id") / 2) == k).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(found.schema).option("pathGlobFilter", "*.parquet").parquet(str(folder))
        after.append({r["path"]: r["dead"] for r in live.applied(stream, own, place).collect()})
    assert after == [{"/r/a": False, "/r/b": True}, {"/r/a": True, "/r/b": True, "/r/c": False}]
    assert {r["path"]: r["dead"] for r in live.applied(stream, own, place).collect()} == after[1]


def test_engine(spark, tmp_path):
    engine = api.Engine(spark, "/r", str(tmp_path))
    engine.reconcile(entries(spark, ["", "a.c", "b.c", "sub/"]).select("root", "path", "is_dir"))
    engine.record(events(spark, [(0, "open", "b.c"), (5, "open", "a.c"), (100, "open", "b.c"), (200, "delete", "sub")]))
    assert names(engine.query(".c")) == ["/r/b.c", "/r/a.c"]
    got = json.loads(engine.reply(".c"))
    assert got["total"] == 2 and got["hits"][0]["path"] == "/r/b.c" and got["indexed"] == 3
    engine.save()
    again = api.Engine(spark, "/r", str(tmp_path))
    assert again.open() and names(again.query(".c", 1)) == ["/r/b.c"]
    again.forget()
    assert [r["score"] for r in again.query(".c").collect()] == [0.0, 0.0]
    assert not api.Engine(spark, "/never", str(tmp_path)).open()
    listed = entries(spark, ["", "new.c"]).select("root", "path", "is_dir")
    watched = api.Engine(spark, "/r", str(tmp_path / "watched"), lister=lambda: (listed, None))
    watched.reconcile(entries(spark, ["", "a.c"]).select("root", "path", "is_dir"))
    assert watched.tick(watched.last_save + 10) is None and watched.tick(watched.last_save + 301) and watched.tick(watched.last_save + 301) is None
    watched.record(events(spark, [(0, "overflow", "a.c")]))
    assert names(watched.query(".c")) == ["/r/new.c"]
    watched.record(events(spark, [(1, "root_gone", "")]))
    assert watched.status()["root_lost"] and watched.status()["indexed"] == 0 and names(watched.query(".c")) == []
    born = api.Engine(spark, "/r", str(tmp_path / "named"), identity=(1, 2, 3))
    born.reconcile(entries(spark, ["", "a.c"]).select("root", "path", "is_dir"))
    born.save()
    moved = api.Engine(spark, "/moved", str(tmp_path / "named"), identity=(1, 2, 3))
    assert not moved.open(identity_of=lambda path: (1, 2, 3))  # the old name still leads there
    assert moved.open() and names(moved.query("a.c")) == ["/moved/a.c"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from treadle.__main__ import run

    monkeypatch.setenv("XDG_STATE_HOME", str(tmp_path / "state"))
    (tmp_path / "tree/sub").mkdir(parents=True)
    for f in ("one.txt", "sub/two.txt"):
        (tmp_path / "tree" / f).write_text("")
    where = str(tmp_path / "tree")
    assert run(["query", ".txt", where], spark) == 0
    assert sorted(capsys.readouterr().out.split()) == [f"{where}/one.txt", f"{where}/sub/two.txt"]
    (tmp_path / "tree/three.txt").write_text("")
    assert run(["query", "three", where], spark) == 1
    assert run(["query", "three", where, "--rescan", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total"] == 1
    assert run(["forget", where], spark) == 0 and run(["clear"], spark) == 0
    assert run(["query", "x", str(tmp_path / "nowhere")], spark) == 2
    with pytest.raises(SystemExit) as e:
        run(["query", "x", where, "--limit", "21"], spark)
    assert e.value.code == 2
    for days in ("nan", "inf", "-1", "x"):
        with pytest.raises(SystemExit):
            run(["query", "x", where, "--half-life", days], spark)


def test_plans_push_down_and_stay_narrow(spark, tmp_path):
    entries(spark, ["a.c", "sub/", "sub/b.c"]).write.parquet(str(tmp_path / "entries"))
    stored = spark.read.parquet(str(tmp_path / "entries"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prefix = plan(search.search(stored, "/r", "sub/"))
    assert "StringStartsWith(path,/r/sub/)" in prefix and "TakeOrderedAndProject" in prefix and "Exchange" not in prefix
    token = plan(search.search(stored, "/r", "b.c"))
    assert "TakeOrderedAndProject" in token and "Exchange" not in token
    batch = plan(search.batch_search(stored, spark.createDataFrame([(0, "/r", "b.c")], "qid int, root string, text string")))
    assert "BroadcastHashJoin" in batch and "WindowGroupLimit" in batch and "CartesianProduct" not in batch
