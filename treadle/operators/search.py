"""Root, prefix and substring queries: the best of (tier, score, path), and totals of all matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.constants import TOP_K
from treadle.functions.paths import basename, query_kind, query_prefix, tier
from treadle.functions.tokens import probe_segments

HIT = ["path", "is_dir", "tier", "score"]


def live(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("dead"))


def root_matches(entries: DataFrame, root: str) -> DataFrame:
    """What lies directly in the root; the root itself doesn't."""
    inside = root if root.endswith("/") else f"{root}/"
    rest = F.substring(F.col("path"), F.lit(len(inside) + 1), F.length("path"))
    return live(entries).where((F.col("root") == root) & F.startswith(F.col("path"), F.lit(inside)) & (rest != "") & ~F.contains(rest, F.lit("/"))).withColumn("tier", F.lit(0))


def prefix_matches(entries: DataFrame, root: str, text: str) -> DataFrame:
    """Paths that begin with the text, joined to the root unless it is absolute: pushed to the scan."""
    prefix = text if text.startswith("/") else f"{root.rstrip('/')}/{text}"
    return live(entries).where((F.col("root") == root) & F.startswith(F.col("path"), F.lit(prefix))).withColumn("tier", F.lit(0))


def token_matches(entries: DataFrame, root: str, text: str) -> DataFrame:
    """Names that hold the text."""
    own = live(entries).where((F.col("root") == root) & F.contains(basename(F.col("path")), F.lit(text)))
    return own.withColumn("tier", tier(F.col("path"), text))


def by_token(text: str) -> bool:
    """Whether a query looks for a part of a name."""
    return len(text.encode()) > 1 and "/" not in text


def matches(entries: DataFrame, root: str, text: str) -> DataFrame:
    if not text:
        return root_matches(entries, root)
    return token_matches(entries, root, text) if by_token(text) else prefix_matches(entries, root, text)


def top(found: DataFrame, limit: int = TOP_K) -> DataFrame:
    """The hits, best first: lower tier, higher score, lower path by byte. At most 20 whatever the limit."""
    return found.select(*HIT).orderBy("tier", F.desc("score"), "path").limit(min(limit, TOP_K))


def search(entries: DataFrame, root: str, text: str, limit: int = TOP_K) -> DataFrame:
    return top(matches(entries, root, text), limit)


def total(entries: DataFrame, root: str, text: str) -> int:
    return matches(entries, root, text).count()


def probe_counts(postings: DataFrame, text: str) -> DataFrame:
    """(place, segment, postings) of a query's segments: pairs whose token begins with the segment."""
    spark = postings.sparkSession
    found = [(k, s) for k, s in enumerate(probe_segments(text))]
    segments = spark.createDataFrame(found, "place int, segment string")
    aggs = [F.count_if(F.startswith(F.col("token"), F.lit(s))).alias(str(k)) for k, s in found]
    if not aggs:
        return segments.withColumn("postings", F.lit(0).cast("long"))
    row = postings.agg(F.array(*aggs).alias("n"))
    return row.select(F.posexplode("n").alias("place", "postings")).join(F.broadcast(segments), "place").select("place", "segment", "postings")


def choose_probe(postings: DataFrame, text: str) -> str | None:
    """The segment with the fewest postings; ties: the longer one in bytes, then the earlier."""
    best = min(probe_counts(postings, text).collect(), key=lambda r: (r["postings"], -len(r["segment"].encode()), r["place"]), default=None)
    return best["segment"] if best else None


def indexed_matches(entries: DataFrame, postings: DataFrame, root: str, text: str) -> DataFrame:
    """Token matches by way of the postings of the chosen segment; all names where no segment is long enough."""
    probe = choose_probe(postings, text)
    if probe is None:
        return token_matches(entries, root, text)
    near = postings.where((F.col("root") == root) & F.startswith(F.col("token"), F.lit(probe))).select("root", "path").distinct()
    return token_matches(entries.join(near, ["root", "path"], "left_semi"), root, text)


def batch_condition(path: Column, root: Column, text: Column) -> Column:
    """Whether a path answers a query, by the query's kind."""
    kind = query_kind(text)
    inside = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    rest = F.substring(path, F.length(inside) + 1, F.length(path))
    direct = F.startswith(path, inside) & (rest != "") & ~F.contains(rest, F.lit("/"))
    return F.when(kind == "root", direct).when(kind == "prefix", F.startswith(path, query_prefix(text, root))).otherwise(F.contains(basename(path), text))


def batch_matches(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, path, is_dir, tier, score) of every query (qid, root, text); queries are few and broadcast, met by root."""
    own = live(entries).join(F.broadcast(queries.withColumnRenamed("root", "q_root")), (F.col("root") == F.col("q_root")) & batch_condition(F.col("path"), F.col("q_root"), F.col("text")))
    place = F.when(query_kind(F.col("text")) == "token", tier(F.col("path"), F.col("text"))).otherwise(0)
    return own.withColumn("tier", place).select("qid", *HIT)


def batch_search(entries: DataFrame, queries: DataFrame, limit: int = TOP_K) -> DataFrame:
    """Hits with their rank for every query; each task passes on its own best of a query at most."""
    best = Window.partitionBy("qid").orderBy("tier", F.desc("score"), "path")
    return batch_matches(entries, queries).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= min(limit, TOP_K))


def batch_totals(entries: DataFrame, queries: DataFrame) -> DataFrame:
    found = batch_matches(entries, queries).groupBy("qid").agg(F.count("*").alias("total"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("total", F.lit(0)).alias("total"))
