"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.plans.storage import release, stored

__all__ = ["hash_sample", "in_fold", "let", "release", "stored", "table", "tidied", "window_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda over columns)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def hash_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, chosen by a hash of ``key``; the same rows in every run."""
    if total <= rows:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(scale)) < int(scale * rows / total))


def window_of(text: str, chars: int, salt: int = 0) -> Column:
    """The text, or ``chars`` characters of a longer one, from a place that a hash of it gives."""
    place = 1 + F.pmod(F.xxhash64(F.lit(salt), F.col(text)), F.greatest(F.length(text) - chars + 1, F.lit(1)))
    return F.substring(F.col(text), place.cast("int"), F.lit(chars))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the Python worker, which waits for its next task, gives back the memory that it freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
