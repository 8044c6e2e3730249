"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams of three to five (with edge marks) and itself, each hashed to a row of an embedding
table; its vector is their mean. Words are averaged twice: plainly over segments of SEGMENT_WORDS in a row, and the segments' vectors
over the whole text, each weighted by exp(SHARPNESS * its margin), so that a few words in a long text count nearly as they do in
a short one. That average goes into a linear softmax over two classes. Embeddings and softmax are trained together in numpy with
Adam on whole documents: first with flat weights, then as sharp as scores are. A misspelling shares most n-grams with the word it comes from.

It is fitted on a bounded sample: SAMPLE documents of each label, chosen by a hash of the id among labelled rows; of a text of more than
SAMPLE_CHARS characters, that many from a place that the hash gives. Scoring reads whole texts. A word's part in the score is
kept in a cache of CACHE words per worker.

Null and empty texts, and texts without words, get the score of the bias alone. Repeated rows each get their score;
equal texts have equal scores. Where one id has several labels, the highest counts, and where it has several texts, each of them has it.
Without labelled rows of both labels every score is the share of label 1, or 0 without any. Very long texts are averaged word by word
in one pass. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.llm.common import hash_sample, tidied, window_of

SAMPLE = 1500
SAMPLE_CHARS = 5000
SEGMENT_WORDS = 2
SHARPNESS = 4.0
BUCKETS = 1 << 16
DECAY = 3e-5
DIMS = 12
CACHE = 150_000
#: Words whose n-grams are hashed at once.
SLICE = 20_000
#: Documents that training looks at, the same ones again where there are fewer.
VISITS = 12_000
#: The rarer label weighs up to this much more.
RARE_WEIGHT = 4.0
#: Buckets of fewer training documents than this are left at zero, so that no word is learned by heart.
LEAST_DOCUMENTS = 3
_WORDS = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def subwords(unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of each word and of the word itself, in order of words."""
    if not unique:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in unique).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in unique])
    ends = np.cumsum(size)
    starts, owner = ends - size, np.repeat(np.arange(len(unique)), size)
    left = ends[owner] - np.arange(len(points))
    hashes, owners = [], []
    h = points + np.uint64(1)
    for n in range(2, 6):
        h = h[: len(points) - n + 1] * _MULTIPLIER + points[n - 1 :]
        h ^= h >> np.uint64(29)
        if n >= 3:
            fit = left[: len(h)] >= n
            hashes.append(h[fit] * np.uint64(2 * n + 1))
            owners.append(owner[: len(h)][fit])
    place = (np.arange(len(points)) - starts[owner]).astype(np.uint64)
    mixed = (points + np.uint64(7)) * (place * np.uint64(0xBF58476D1CE4E5B9) + _MULTIPLIER)
    mixed ^= mixed >> np.uint64(31)
    hashes.append(np.add.reduceat(mixed * _MULTIPLIER, starts))
    owners.append(np.arange(len(unique)))
    own, found = np.concatenate(owners), np.concatenate(hashes)
    found = (found ^ (found >> np.uint64(32))) * _MULTIPLIER
    order = np.argsort(own, kind="stable")
    return (found >> np.uint64(40)).astype(np.int64)[order] % BUCKETS, own[order]


def segment_starts(n: int) -> list[int]:
    return list(range(0, max(n, 1), SEGMENT_WORDS))


class Model:
    """Per bucket, the embedding's part along the softmax's direction; that is all that a margin needs."""

    def __init__(self, along: np.ndarray, bias: float):
        self.along, self.bias = along.astype(np.float32), float(bias)

    def word_parts(self, unique: list[str]) -> np.ndarray:
        bucket, owner = subwords(unique)
        n = np.bincount(owner, minlength=len(unique))
        return np.bincount(owner, weights=self.along[bucket], minlength=len(unique)) / np.maximum(n, 1)


def sharp_average(margins: np.ndarray) -> float:
    weight = np.exp(SHARPNESS * (margins - margins.max()))
    return float(weight @ margins / weight.sum())


class Scorer:
    def __init__(self, model: Model):
        self.model, self.parts = model, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [words(t) for t in texts]
        if len(self.parts) > CACHE:
            self.parts.clear()
        fresh = list({w for own in found for w in own if w not in self.parts})
        for k in range(0, len(fresh), SLICE):
            own = fresh[k : k + SLICE]
            self.parts.update(zip(own, self.model.word_parts(own).tolist(), strict=True))
        of, out = self.parts.__getitem__, np.empty(len(texts))
        for k, own in enumerate(found):
            if own:
                values = np.fromiter(map(of, own), np.float64, len(own))
                starts = segment_starts(len(own))
                sums = np.add.reduceat(values, starts)
                sizes = np.diff([*starts, len(own)])
                out[k] = sharp_average(sums / sizes)
            else:
                out[k] = 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -60, 60)))


def train(texts: list[str], labels: list[int], visits: int = VISITS, batch: int = 48, rate: float = 0.015, seed: int = 1) -> Model:
    """Embeddings and softmax together, on documents in batches."""
    if not texts or len(set(labels)) < 2:
        share = sum(labels) / len(labels) if texts else 0.0
        return Model(np.zeros(BUCKETS), 40.0 if share > 0.5 else -40.0)
    rng = np.random.default_rng(seed)
    docs = [words(t) for t in texts]
    ids: dict[str, int] = {}
    coded = [np.array([ids.setdefault(w, len(ids)) for w in d], np.int64) for d in docs]
    del docs
    unique = list(ids)
    parts = [subwords(unique[k : k + SLICE]) for k in range(0, len(unique), SLICE)]
    bucket = np.concatenate([b for b, _ in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.bincount(o) for _, o in parts]))]) if parts else np.zeros(1, np.int64)
    del unique, parts, ids
    seen = np.zeros(BUCKETS, np.int64)
    for own in coded:
        if len(own):
            unique = np.unique(own)
            seen[np.unique(np.concatenate([bucket[first[w] : first[w + 1]] for w in unique]))] += 1
    known = (seen >= LEAST_DOCUMENTS).astype(np.float32)[:, None]
    table = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32) * known
    soft = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, soft, bias]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y, step = np.array(labels, np.float32), 0
    rarer = np.clip(np.sqrt((1 - y).sum() / y.sum()), 1 / RARE_WEIGHT, RARE_WEIGHT)
    weight = np.where(y == 1, rarer, 1.0).astype(np.float32)
    epochs = max(2, min(60, round(visits / len(coded))))
    for epoch in range(epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), batch):
            own = [d for d in order[at : at + batch] if len(coded[d])]
            if not own:
                continue
            flat = np.concatenate([coded[d] for d in own])
            local, word = np.unique(flat, return_inverse=True)
            spans = [np.arange(first[w], first[w + 1]) for w in local]
            counts = np.array([len(s) for s in spans])
            rows = bucket[np.concatenate(spans)]
            begin = np.cumsum(counts) - counts
            vectors = np.add.reduceat(table[rows], begin) / counts[:, None]
            starts, segments, base = [], [], 0
            for d in own:
                s = segment_starts(len(coded[d]))
                segments.append(len(s))
                starts += [base + x for x in s]
                base += len(coded[d])
            sizes = np.diff([*starts, base])
            means_of = np.add.reduceat(vectors[word], starts) / sizes[:, None]
            logits = means_of @ soft + bias
            margin = logits[:, 1] - logits[:, 0]
            head = np.cumsum(segments) - segments
            of_doc = np.repeat(np.arange(len(own)), segments)
            top = np.maximum.reduceat(margin, head)
            share = np.exp(np.clip((margin - top[of_doc]) * (1 if epoch < epochs // 2 else SHARPNESS), -60, 0))
            share /= np.add.reduceat(share, head)[of_doc]
            z = np.add.reduceat(share * margin, head)
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
            g = (share * wrong[of_doc]).astype(np.float32)
            g2 = np.stack([-g, g], 1)
            grad_soft, grad_bias = means_of.T @ g2, g2.sum(0)
            per_word = np.repeat((g2 @ soft.T) / sizes[:, None], sizes, axis=0)
            grad_vectors = np.stack([np.bincount(word, weights=per_word[:, k], minlength=len(local)) for k in range(DIMS)], 1) / counts[:, None]
            per_row = np.repeat(grad_vectors, counts, axis=0)
            touched, place = np.unique(rows, return_inverse=True)
            grad_table = np.stack([np.bincount(place, weights=per_row[:, k], minlength=len(touched)) for k in range(DIMS)], 1).astype(np.float32) * known[touched]
            grad_table += DECAY * table[touched]
            step += 1
            for p, m, v, grad, rows_of in zip(params, means, squares, (grad_table, grad_soft, grad_bias), (touched, slice(None), slice(None)), strict=True):
                m[rows_of] = 0.9 * m[rows_of] + 0.1 * grad
                v[rows_of] = 0.99 * v[rows_of] + 0.01 * grad**2
                p[rows_of] -= rate * (m[rows_of] / (1 - 0.9**step)) / (np.sqrt(v[rows_of] / (1 - 0.99**step)) + 1e-7)
    return Model(table @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``allowed``: over the label table's ids, which rows may be learned from. Only the sample's texts come to the driver."""
    marked = labels.where(allowed & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("id is not null")
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # two at most
    wanted = None
    for label, total in sorted(totals.items()):
        part = hash_sample(marked.where(F.col("label") == label), F.col("id"), SAMPLE, total).limit(2 * SAMPLE)
        wanted = part if wanted is None else wanted.unionByName(part)
    if wanted is None:
        return train([], [])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    rows = rows.select(window_of("text", SAMPLE_CHARS).alias("text"), "label").orderBy(F.xxhash64("text")).limit(6 * SAMPLE).collect()
    rows = sorted((r["text"], int(r["label"])) for r in rows)
    return train([t for t, _ in rows], [k for _, k in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    fields = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                yield part.filter(pa.array(scorer.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(tidied(run), fields)
