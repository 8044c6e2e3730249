"""Catalogs, events and literal rows over the star-schema tables, for queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.functions.paths import ancestors

ROOT = "/data"
#: The characters that SQL's trim takes off both ends of a text: all of Unicode's space separators.
SPACES = " \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: The first word of the trimmed text: its wide spaces belong to it, unless only spaces follow to the text's end.
WORD = f"^[{SPACES}]*+((?:[^{SPACES}\n]++|[{SPACES[1:]}]++(?![{SPACES}]*+\\\\z))*+)"
#: That word without dots and slashes, or x; it looks no further into the text than that.
FIRST_WORD = f"coalesce(nullif(regexp_replace(regexp_extract(text, '{WORD}', 1), '[./]', ''), ''), 'x')"

#: Query texts of every kind: root, prefixes, tokens.
TEXTS = ["", "p", "parts/", "/data/docs/fr", "ring", "ring_1", "a.", "é", ".csv", "small", "Customer#00000001", "_12", "en"]

TIER_ROWS = [("/r/rank.c",), ("/r/rank.cpp",), ("/r/page-rank.c",), ("/r/pagerank.c",), ("/r/a.c",), ("/r/b.a.c",), ("/r/x rank.c y",)]
TIER_TEXTS = ["rank.c", ".c", "rank"]

SNAPSHOT_ROWS = [
    ("", 1.0, 0.0, True), ("a", 0.0, 2.0, False), ("/a", 0.0, 0.0, False), ("a//b", 0.0, 0.0, False), ("./a", 0.0, 0.0, False),
    ("a/..", 0.0, 0.0, False), ("a/b", float("nan"), 0.0, False), ("a/c", -1.0, 0.0, False), ("a/d", 0.0, float("inf"), False), ("a/e..f", 0.5, 0.5, False),
]
SNAPSHOT_EDGES = [(0, 1, 0.009), (1, 0, 0.01), (0, 10, 1.0), (-1, 0, 1.0), (1, 1, -0.5), (0, 9, 0.0)]

#: (root, dev, ino, btime): roots looked for, snapshots there are, and what the old names lead to now.
ROOTS = [("/new", 1, 10, 500), ("/other", 1, 11, 0), ("/second", 1, 12, 700), ("/reused", 1, 13, 800), ("/known", 1, 14, 900)]
SAVED = [("/old", 1, 10, 500), ("/zero", 1, 11, 0), ("/first", 1, 12, 700), ("/gone", 1, 13, 799), ("/known", 1, 14, 900), ("/was", 1, 14, 900)]
REACHABLE = [("/first", 1, 12, 700), ("/gone", 1, 99, 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path, source) of every file."""
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    parts = [
        ("part", table(spark, sf_dir, "part"), "concat('/data/parts/', p_brand, '/', p_type, '/', p_name, '_', p_partkey, '.csv')"),
        ("customer", table(spark, sf_dir, "customer"), "concat('/data/customers/', c_mktsegment, '/', c_name, '.vcf')"),
        ("supplier", suppliers, "concat('/data/suppliers/', n_name, '/', s_name, '.json')"),
        ("documents", table(spark, sf_dir, "documents"), f"concat('/data/docs/', lang, '/', source, '/', {FIRST_WORD}, '-', doc_id, '.txt')"),
        ("pages", table(spark, sf_dir, "pages"), "concat('/data/web/', trim(TRAILING '/' FROM regexp_replace(url, '^[a-z]+://', '')))"),
    ]
    out = None
    for source, df, path in parts:
        own = df.select(F.lit(ROOT).alias("root"), F.expr(path).alias("path"), F.lit(source).alias("source")).where("path is not null")
        out = own if out is None else out.unionByName(own)
    return out


def with_directories(found: DataFrame) -> DataFrame:
    """(root, path, is_dir) of files and all directories above them."""
    dirs = found.select("root", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return found.select("root", "path", F.lit(False).alias("is_dir")).unionByName(dirs.select("root", "path", F.lit(True).alias("is_dir")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog, alive, without scores."""
    return with_directories(files(spark, sf_dir)).withColumns({"dead": F.lit(False), "score": F.lit(0.0)})


def old_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files known before: parts, documents and customers, of which those in debt are dead."""
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.expr("concat('/data/customers/', c_mktsegment, '/', c_name, '.vcf')").alias("path"), F.lit(True).alias("dead"))
    own = files(spark, sf_dir).where("source in ('part', 'customer', 'documents')").select("root", "path", F.lit(False).alias("is_dir"))
    return own.join(debt, "path", "left").select("root", "path", "is_dir", F.coalesce("dead", F.lit(False)).alias("dead"))


def new_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found now: customers, suppliers, documents and pages."""
    return files(spark, sf_dir).where("source <> 'part'").select("root", "path", F.lit(False).alias("is_dir"))


def bound(events: DataFrame) -> DataFrame:
    """(event_id, ts, root, path, kind, is_dir): user activity as opens, edits, creates and deletes of 80 files."""
    root = "concat('/events/r', user_id % 4)"
    path = f"concat({root}, '/item_', cast(get_json_object(props, '$.k') as bigint) % 20, '.log')"
    kind = "case event_type when 'click' then 'open' when 'view' then 'open' when 'purchase' then 'edit' when 'signup' then 'create' when 'error' then 'delete' end"
    return events.select("event_id", "ts", F.expr(root).alias("root"), F.expr(path).alias("path"), F.expr(kind).alias("kind"), F.lit(False).alias("is_dir"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(table(spark, sf_dir, "events"))


#: The root that is lost in ``lost_events``.
LOST_ROOT = "/events/r3"


def tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same activity in four directories a root: creates of even items are moves into the tree, deletes of every fifth item take its
    whole directory, and opens of the last item are opens of its directory."""
    item = F.expr("cast(regexp_extract(path, '_([0-9]+)', 1) as bigint)")
    rows = events(spark, sf_dir).withColumn("item", item)
    whole = ((F.col("kind") == "delete") & (F.col("item") % 5 == 0)) | ((F.col("kind") == "open") & (F.col("item") == 19))
    directory = F.concat("root", F.lit("/d"), F.col("item") % 4)
    path = F.when(whole, directory).otherwise(F.concat(directory, F.lit("/item_"), "item", F.lit(".log")))
    kind = F.when((F.col("kind") == "create") & (F.col("item") % 2 == 0), "move_in").otherwise(F.col("kind"))
    return rows.select("event_id", "ts", "root", path.alias("path"), kind.alias("kind"), whole.alias("is_dir"))


def lost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree_events``, where the last event of one root is that the root goes away."""
    found = tree_events(spark, sf_dir)
    last = found.where(F.col("root") == LOST_ROOT).agg(F.max_by("event_id", F.struct("ts", "event_id"))).first()[0]
    gone = (F.col("root") == LOST_ROOT) & (F.col("event_id") == F.lit(last))
    return found.withColumn("kind", F.when(gone, "root_gone").otherwise(F.col("kind")))


def event_entries(found: DataFrame) -> DataFrame:
    """The files of the events, all alive before the first one."""
    return found.select("root", "path", "is_dir").distinct().withColumn("dead", F.lit(False))


def query_rows(spark: SparkSession, texts: list[str] = TEXTS, root: str = ROOT) -> DataFrame:
    return spark.createDataFrame([(k, root, t) for k, t in enumerate(texts)], "qid int, root string, text string")
