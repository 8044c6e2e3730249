"""Replies as one JSON line with members in a fixed order, and a strict reader of such lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treadle.constants import TOP_K

SCHEMA = "total int, root string, indexed int, scan_done boolean, unwatched int, root_lost boolean, index_gen long, score_gen long, hits array<struct<path: string, score: double, is_dir: boolean>>"
MEMBERS = ["total", "root", "indexed", "scan_done", "unwatched", "root_lost", "index_gen", "score_gen", "hits"]
HIT_MEMBERS = ["path", "score", "is_dir"]


def replies(hits: DataFrame, totals: DataFrame, status: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, reply) for queries (qid, root, text): ``hits`` have qid, rank and at most 20 rows each."""
    hit = F.struct("rank", "path", F.col("score").cast("decimal(20,4)").alias("score"), "is_dir")
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("ranked"))
    rows = queries.select("qid", "root").join(totals, "qid").join(status, "root").join(lists, "qid", "left")
    plain = F.transform(F.coalesce("ranked", F.array().cast("array<struct<rank:int,path:string,score:decimal(20,4),is_dir:boolean>>")), lambda h: F.struct(h["path"].alias("path"), h["score"].alias("score"), h["is_dir"].alias("is_dir")))
    members = [F.col("total").cast("int").alias("total"), *[F.col(c) for c in MEMBERS[1:8]], plain.alias("hits")]
    return rows.select("qid", F.to_json(F.struct(*members)).alias("reply"))


def parsed(lines: DataFrame, col: str = "line") -> DataFrame:
    """``lines`` with ``ok`` and the members. Members may come in any order; an unknown one, a wrong type, text that
    isn't one object, no member at all or more than 20 hits make a line bad."""
    reply = F.try_parse_json(F.col(col))
    alone = F.size(F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>")) == 1  # nothing follows the object
    keys = F.json_object_keys(col)
    value = F.from_json(F.col(col), SCHEMA, {"mode": "PERMISSIVE"})
    allowed = lambda found, names: F.forall(found, lambda k: k.isin(*names))
    hit_keys = F.from_json(F.get_json_object(col, "$.hits"), "array<map<string,string>>")
    fine = reply.isNotNull() & alone & (F.size(keys) > 0) & allowed(keys, MEMBERS)
    fine = fine & F.forall(F.coalesce(hit_keys, F.array().cast("array<map<string,string>>")), lambda m: allowed(F.map_keys(m), HIT_MEMBERS))
    for name in MEMBERS[:8]:  # a member that stands there was read
        fine = fine & (~F.array_contains(keys, name) | value[name].isNotNull())
    hits = F.coalesce(value["hits"], F.array().cast("array<struct<path:string,score:double,is_dir:boolean>>"))
    fine = fine & (~F.array_contains(keys, "hits") | value["hits"].isNotNull()) & (F.size(hits) <= TOP_K)
    return lines.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("reply", F.when(F.col("ok"), value))


def plain_lines(hits: DataFrame) -> DataFrame:
    """One path per line, in rank order."""
    return hits.orderBy("rank").select("path")


def best_first(hits: DataFrame) -> DataFrame:
    order = Window.orderBy("tier", F.desc("score"), "path")
    return hits.withColumn("rank", F.row_number().over(order))


