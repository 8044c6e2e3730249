"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors become whole numbers, floor(scale * x). For a segment of L dimensions with means m and deviations s of a query
and a candidate, their squared distance there is at least L * ((m1 - m2)^2 + (s1 - s2)^2). The distance and the inner
product differ by the known norms only, so that bound is one from above on the product:
sum of L * (m1 * m2 + s1 * s2). It is taken with few segments first, then with more over the pairs that are left, then with the
leading half, three quarters and seven eighths of the dimensions as segments of their own (whose products are exact) and one segment for the
rest; what survives the finest level against the query's tenth best so far gets its exact product in whole numbers, and nothing else does.
The bounds prune as far as vectors differ in their segments: on vectors without any structure only the last levels do.

Candidates travel as blocks of up to BLOCK vectors, packed where they are read; queries as blocks of about as many, joined to each
candidate block by block number. Query blocks are broadcast only if their bytes, from a count, are under BROADCAST_BYTES, and
candidates aren't shuffled then; otherwise the join shuffles both, with the candidate blocks of one query block spread by a salt. A task
keeps ten results for each query of the blocks that are broadcast, or of one block.

A null vector, or one with a null or non-finite component, takes no part; neither does a null id. Whole-number
components are doubles, exact at any size. Products are taken in doubles or longs where the largest components can't exceed them, in
Python's integers otherwise; a score in the result that doesn't fit into a long is an error. Vectors of different
lengths aren't compared. A row is no candidate for queries of its own id. Every row is a candidate, so one that is repeated can come
in the result as often; a query that is repeated is asked once, and different vectors under one id are queries of their own. Ties go to
the smaller id. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 4096
BROADCAST_BYTES = 32_000_000
WHOLE = 2.0**53  # doubles from here on are whole numbers
SALTS = 16


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, dims, v) with whole-number components; rows that take no part are gone."""
    floor = lambda y: F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)
    x = F.transform(F.col(vec_col), lambda c: floor(c.cast("double") * scale))
    fine = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dims"), x.alias("v"))


def _packed(ids: np.ndarray, vectors: list) -> dict:
    """Ids and components as bytes."""
    matrix = np.vstack([np.asarray(v, np.float64) for v in vectors])
    return {"dims": matrix.shape[1], "ids": ids.astype(np.int64).tobytes(), "matrix": matrix.tobytes()}


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one number of dimensions each, up to BLOCK vectors in one."""
    for pdf in parts:
        out = []
        for _, part in pdf.groupby("dims", sort=True):
            for k in range(0, len(part), BLOCK):
                out.append(_packed(part["id"].to_numpy()[k : k + BLOCK], part["v"].tolist()[k : k + BLOCK]))
        yield pd.DataFrame(out, columns=["dims", "ids", "matrix"])


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that their product bounds the inner product from above."""
    n, dims = x.shape
    edges = np.linspace(0, dims, segments + 1).round().astype(int)
    out = np.zeros((n, 2 * segments))
    for k in range(segments):
        part = x[:, edges[k] : edges[k + 1]]
        if part.shape[1]:
            out[:, 2 * k] = part.mean(1) * np.sqrt(part.shape[1])
            out[:, 2 * k + 1] = part.std(1) * np.sqrt(part.shape[1])
    return out


def bound_parts(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each level, coarse to fine, figures whose inner product bounds that of the vectors from above."""
    dims = x.shape[1]
    for segments in (1, 4, 16):
        if 2 * segments < dims:
            yield segment_statistics(x, segments)
    for eighths in (4, 6, 7):
        lead = dims * eighths // 8
        if dims >= 8:
            yield np.concatenate([x[:, :lead], segment_statistics(x[:, lead:], 1)], 1)


class Best:
    """The k best (score, id) of each query of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.k, self.x = ids, k, matrix.astype(np.float64)
        self.most = int(np.abs(self.x).max(initial=0))
        self.levels = list(bound_parts(self.x))
        self.norms = np.sqrt((self.x**2).sum(1))
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        self.pairs = self.exact_pairs = 0

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for k in range(0, len(ids), 1024):  # the first slice gives thresholds for the next ones
            self._add(ids[k : k + 1024], matrix[k : k + 1024])

    def _alive(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(queries, candidates): the pairs that can still be among the best."""
        alive = self.ids[:, None] != ids[None, :]
        if not np.isfinite(self.floor).any():
            return alive
        slack = 1e-9 * (1 + self.norms[:, None] * np.sqrt((x**2).sum(1))[None, :])
        for q, c in zip(self.levels, bound_parts(x), strict=True):
            if alive.mean() > 0.2:
                alive &= ~(q @ c.T + slack < self.floor[:, None])  # what overflows to NaN stays
            else:
                r, k = np.nonzero(alive)
                for at in range(0, len(r), 65536):
                    i, j = r[at : at + 65536], k[at : at + 65536]
                    alive[i, j] = ~(np.einsum("ij,ij->i", q[i], c[j]) + slack[i, j] < self.floor[i])
        return alive

    def _add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        x = matrix.astype(np.float64)
        alive = self._alive(ids, x)
        self.pairs += alive.size
        most = int(np.abs(x).max(initial=0))
        bound = matrix.shape[1] * max(1, self.most) * max(1, most)
        rows = [(r, np.flatnonzero(alive[r])) for r in np.flatnonzero(alive.any(1))]
        if bound < 2**53:  # whole numbers below 2^53: exact in doubles
            scored = [(r, k, (x[k] @ self.x[r]).astype(np.int64)) for r, k in rows]
        elif bound < 2**63:
            whole = x.astype(np.int64)
            scored = [(r, k, whole[k] @ self.x[r].astype(np.int64)) for r, k in rows]
        else:
            whole = [[int(v) for v in row] for row in x]
            scored = []
            for r, k in rows:
                own = [int(v) for v in self.x[r]]
                scored.append((r, k, np.array([sum(map(int.__mul__, whole[c], own)) for c in k], object)))
        for r, k, score in scored:
            self.exact_pairs += len(k)
            s0, i0 = self.found[r]
            s, i = np.concatenate([s0, score]), np.concatenate([i0, ids[k]])
            if len(s) > 4 * self.k:  # only those that can still be among the best, ties included
                near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[near], i[near]
            order = np.lexsort((i, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda n: (-s[n], i[n]))[: self.k], np.int64)
            self.found[r] = s[order], i[order]
            if len(order) == self.k:
                self.floor[r] = s[order[-1]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest whole-number inner products with each query."""
    whole = quantised(vectors, scale, id_col, vec_col)
    asked = quantised(vectors.where(is_query), scale, id_col, vec_col).dropDuplicates(["id", "v"])
    n_queries, dims = asked.agg(F.count("*"), F.max("dims")).first()
    blocks = max(1, -(-n_queries // BLOCK))
    few = n_queries * (8 + 8 * (dims or 0)) <= BROADCAST_BYTES

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [_packed(part["id"].to_numpy(), part["v"].tolist()) for _, part in pdf.groupby("dims", sort=True)]
        return pd.DataFrame(rows, columns=["dims", "ids", "matrix"]).assign(block=key[0])

    packed = "dims int, ids binary, matrix binary"
    number = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    queries = asked.withColumn("block", number).groupBy("block").applyInPandas(pack, f"{packed}, block int")
    queries = queries.select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    candidates = whole.mapInPandas(_blocks, packed).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if few:
        pairs = candidates.join(F.broadcast(queries), ["q_block", "dims"])
    else:
        queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
        pairs = candidates.join(queries, ["q_block", "salt", "dims"]).sortWithinPartitions("q_block", "dims")
    pairs = pairs.select("q_block", "dims", "ids", "matrix", "q_ids", "q_matrix")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(best: Best) -> pd.DataFrame:
            found = [(int(best.ids[r]), best.x[r].tobytes(), int(i), Decimal(int(s))) for r in range(len(best.ids)) for s, i in zip(*best.found[r], strict=True)]
            return pd.DataFrame(found, columns=["query_id", "query", "vec_id", "score"])

        held: dict[tuple[int, int], Best] = {}
        for pdf in parts:
            for q_block, d, ids, matrix, q_ids, q_matrix in pdf.itertuples(index=False, name=None):
                if (q_block, d) not in held:
                    if not few:  # sorted: the block before has ended
                        yield from map(rows, held.values())
                        held = {}
                    own = np.frombuffer(q_ids, np.int64)
                    held[q_block, d] = Best(own, np.frombuffer(q_matrix, np.float64).reshape(len(own), d), k)
                n = np.frombuffer(ids, np.int64)
                held[q_block, d].add(n, np.frombuffer(matrix, np.float64).reshape(len(n), d))
        yield from map(rows, held.values())

    found = pairs.mapInPandas(search, "query_id long, query binary, vec_id long, score decimal(38,0)")
    by = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
