"""Snapshots: live nodes with compact ids, live edges by id, sizes, validation, saving, loading, adoption."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.constants import ALPHA, EDGE_MIN_WEIGHT
from treadle.functions.paths import fnv1a_64, joined, relative, relative_ok
from treadle.plans.blocks import ordinals

#: Bytes of the binary form: magic, fixed header, node without path, edge, counts and time at the end.
MAGIC_BYTES, HEADER_BYTES, NODE_BYTES, EDGE_BYTES, TAIL_BYTES = 4, 28, 21, 16, 16
NODE_SCHEMA = "root string, id int, rel string, pgrk double, opens double, is_dir boolean"
EDGE_SCHEMA = "root string, src int, dst int, weight double"


def snapshot_nodes(entries: DataFrame, opens: DataFrame) -> DataFrame:
    """Live entries in byte order of their path, numbered from 0 per root; ``entries`` have a synced score, of which ``pgrk`` is the settled mass."""
    own = entries.where(~F.col("dead")).join(opens.select("root", "path", "opens"), ["root", "path"], "left")
    numbered = ordinals(own.select("root", "path", "is_dir", "score", F.coalesce("opens", F.lit(0.0)).alias("opens")), ["root"], ["path"], "id")
    return numbered.select("root", "id", "path", relative(F.col("path"), F.col("root")).alias("rel"), (F.col("score") * (1 - ALPHA)).alias("pgrk"), "opens", "is_dir")


def snapshot_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges heavy enough whose ends are both alive, by compact id."""
    ends = nodes.select("root", "path", "id")
    heavy = edges.where(F.col("weight") >= EDGE_MIN_WEIGHT)
    from_id = heavy.join(ends.withColumnsRenamed({"path": "src", "id": "src_id"}), ["root", "src"])
    both = from_id.join(ends.withColumnsRenamed({"path": "dst", "id": "dst_id"}), ["root", "dst"])
    return both.select("root", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight")


def snapshot_bytes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, bytes) of the binary form."""
    n = nodes.groupBy("root").agg((F.count("*") * NODE_BYTES + F.sum(F.octet_length("rel"))).alias("n"))
    m = edges.groupBy("root").agg((F.count("*") * EDGE_BYTES).alias("m"))
    fixed = MAGIC_BYTES + HEADER_BYTES + TAIL_BYTES
    return n.join(m, "root", "left").select("root", (F.lit(fixed) + F.octet_length("root") + F.col("n") + F.coalesce("m", F.lit(0))).cast("long").alias("bytes"))


def finite(c: str) -> F.Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0)


def node_faults(nodes: DataFrame) -> DataFrame:
    """Every node with whether it may be loaded."""
    fine = relative_ok(F.col("rel")) & finite("pgrk") & finite("opens") & F.col("is_dir").isNotNull()
    return nodes.withColumn("ok", F.coalesce(fine, F.lit(False)))


def edge_faults(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Every edge with whether it may be loaded; ``counts`` has the number of nodes per root."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("n_nodes"))
    return edges.join(F.broadcast(counts), "root", "left").withColumn("ok", F.coalesce(inside("src") & inside("dst") & finite("weight"), F.lit(False))).drop("n_nodes")


def adoptions(roots: DataFrame, saved: DataFrame, reachable: DataFrame) -> DataFrame:
    """(root, old_root): snapshots of renamed roots. ``roots`` have none of their own; identities match on dev, ino and a
    known birth time, and the old name no longer leads to the same directory."""
    own = roots.join(saved.select(F.col("root")), "root", "left_anti").where("btime <> 0")
    old = saved.withColumnRenamed("root", "old_root")
    still = reachable.withColumnRenamed("root", "old_root")
    gone = old.join(still, ["old_root", "dev", "ino", "btime"], "left_anti")
    found = own.join(gone, ["dev", "ino", "btime"])
    return found.groupBy("root").agg(F.min("old_root").alias("old_root"))


def snapshot_name(root: str) -> str:
    return fnv1a_64(root)


def save(folder: str, root: str, nodes: DataFrame, edges: DataFrame, identity: tuple[int, int, int] = (0, 0, 0), last_decay: int | None = None) -> str:
    """A new version under the root's name; the pointer file is written last, so a reader sees a whole version or the one before."""
    spark = nodes.sparkSession
    version = f"{folder}/{snapshot_name(root)}/{time.time_ns()}"
    nodes.where(F.col("root") == root).select("root", "id", "rel", "pgrk", "opens", "is_dir").write.parquet(f"{version}/nodes")
    edges.where(F.col("root") == root).select("root", "src", "dst", "weight").write.parquet(f"{version}/edges")
    dev, ino, btime = identity
    head = {"root": root, "dev": dev, "ino": ino, "btime": btime, "last_decay": int(time.time()) if last_decay is None else last_decay}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{version}/meta")
    return version


def versions(spark: SparkSession, folder: str, root: str) -> list[str]:
    """Complete versions of a root's snapshot, the newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{snapshot_name(root)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(path)]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/meta/_SUCCESS"))]
    return sorted(done, key=lambda p: int(p.rsplit("/", 1)[1]), reverse=True)


def load(spark: SparkSession, folder: str, root: str, saved_as: str | None = None) -> tuple[DataFrame, DataFrame, dict] | None:
    """(nodes with absolute paths, edges, header) of the newest version, or None. One bad row rejects the whole snapshot.

    ``saved_as``: the root's name when it was saved, if that was another; paths are relative, so they come out under the new one.
    """
    old = saved_as or root
    found = versions(spark, folder, old)
    if not found:
        return None
    head = json.loads(spark.read.text(f"{found[0]}/meta").first()["value"])
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{found[0]}/nodes")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{found[0]}/edges")
    counts = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"))
    if head["root"] != old or head["last_decay"] < 0 or not node_faults(nodes).where("not ok").isEmpty() or not edge_faults(edges, counts).where("not ok").isEmpty():
        raise ValueError(f"the snapshot of {root} is damaged")
    path = F.when(F.col("rel") == "", F.lit(root)).otherwise(joined(F.lit(root), F.col("rel")))
    named = lambda df: df.withColumn("root", F.lit(root))
    return named(nodes).withColumn("path", path), named(edges), head


def saved_roots(spark: SparkSession, folder: str) -> DataFrame | None:
    """(root, dev, ino, btime) of all snapshots in a folder; None if there are none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*/meta/_SUCCESS")
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return None
    heads = spark.read.text(f"{folder}/*/*/meta").select(F.from_json("value", "root string, dev long, ino long, btime long").alias("h"))
    return heads.select("h.*").distinct()


def adoptable(spark: SparkSession, folder: str, root: str, identity: tuple[int, int, int], identity_of) -> str | None:
    """The old name of a root that was renamed and has no snapshot under its new one. ``identity_of(path)``: what a path leads to now, or None."""
    saved = saved_roots(spark, folder)
    if saved is None or not identity[2]:
        return None
    same = saved.where((F.col("dev") == identity[0]) & (F.col("ino") == identity[1]) & (F.col("btime") == identity[2]))
    names = [r["root"] for r in same.select("root").distinct().collect()]  # snapshots of one directory's names
    schema = "root string, dev long, ino long, btime long"
    reachable = spark.createDataFrame([(n, *i) for n in names if (i := identity_of(n))], schema)
    found = adoptions(spark.createDataFrame([(root, *identity)], schema), saved, reachable).first()
    return found["old_root"] if found else None


def clear_all(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
