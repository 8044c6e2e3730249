"""Tables written to the shared folder, to cut lineage where a plan would be computed again and again."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Where stored tables are, as long as somebody holds them.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, a temporary one, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    (df.repartition(*by).sortWithinPartitions(*by) if by else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def stored_sorted(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and sorted, so that a prefix of the first column reads few row groups."""
    return stored(df.repartitionByRange(*by).sortWithinPartitions(*by))


def release(*frames: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = _places.pop(df, None)
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
