"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades, and thresholds in ascending order part them: the chance of a
grade above j is sigmoid(x . w - threshold_j). The expected grade and the chance of the top grade (the tail) select documents.
A text's features are the hashed tokens between white space, each as lower-case letters, as a shape (runs of capitals, small
letters, digits and each mark) and as "same as the one before", averaged over the text's tokens with a few figures of the whole text.
Weights and thresholds are trained together in numpy with Adam.

It is fitted on a bounded sample: about SAMPLE texts of each grade, chosen by a hash of the id; of a text of more than SAMPLE_CHARS
characters, that many from a place that a hash gives. More than GRADES different grades are an error: ratings are steps, not a
measurement. Scoring reads whole texts, of any length in one pass; a token's part is cached for up to CACHE tokens per worker.

Null and empty texts, and texts of white space, have no tokens: the thresholds alone grade them, with a feature of their own. Repeated rows
each get their scores, equal texts the same; where one id has several ratings, the least counts. Without ratings of two
grades every text gets the one grade there is, or 0. Grades may be fractions. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.llm.common import tidied, window_of

SAMPLE = 2500
SAMPLE_CHARS = 20_000
GRADES = 100
BUCKETS = 1 << 16
CACHE = 150_000
_RUNS = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]")


def _bucket(kind: str, value: str) -> int:
    h = 1469598103
    for c in f"{kind}:{value}":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


def shape(token: str) -> str:
    out = []
    for run in _RUNS.findall(token):
        kind = ("A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a") if run[0].isalpha() else "9" if run[0].isdigit() else run
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def token_features(token: str) -> tuple[int, int]:
    return _bucket("w", token.lower()), _bucket("s", shape(token))


REPEATED, EMPTY, SHORT_LINES = _bucket("f", "repeated"), _bucket("f", "empty"), _bucket("f", "short lines")


def text_features(text: str | None) -> dict[int, float]:
    """Features besides those of single tokens."""
    if not text or text.isspace():
        return {EMPTY: 1.0}
    tokens = text.split()
    same = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
    return {REPEATED: same, SHORT_LINES: min(1.0, (text.count("\n") + 1) / len(tokens))}


class Model:
    def __init__(self, grades: list[float], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def above(self, margin: np.ndarray) -> np.ndarray:
        """(texts, grades - 1): the chance of a grade above each but the last."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -60, 60)))

    def read(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and chance of the top grade."""
        if len(self.grades) < 2:
            return np.full(len(margin), float(self.grades[0] if self.grades else 0)), np.full(len(margin), 1.0 if self.grades else 0.0)
        above = self.above(margin)
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + above @ steps, above[:, -1]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.parts = model, {}

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        w, parts = self.model.weights, self.parts
        margin = np.zeros(len(texts))
        if len(parts) > CACHE:
            parts.clear()
        for k, text in enumerate(texts):
            tokens = text.split() if text else []
            if tokens:
                for t in {t for t in tokens if t not in parts}:
                    a, b = token_features(t)
                    parts[t] = float(w[a] + w[b])
                margin[k] = sum(map(parts.__getitem__, tokens)) / len(tokens)
            for f, x in text_features(text).items():
                margin[k] += w[f] * x
        return self.model.read(margin)


def train(texts: list[str], grades: list[float], steps: int = 250, batch: int = 256, rate: float = 0.05, seed: int = 1) -> Model:
    kinds = sorted(set(grades))
    if len(kinds) < 2:
        return Model(kinds, np.zeros(BUCKETS), np.zeros(0))
    rng = np.random.default_rng(seed)
    held: dict[str, tuple[int, int]] = {}
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        tokens = text.split()
        found = [f for t in tokens for f in (held.get(t) or held.setdefault(t, token_features(t)))]
        ids, n = np.unique(np.array(found, np.int64), return_counts=True)
        more = text_features(text)
        rows.append((np.concatenate([ids, list(more)]).astype(np.int64), np.concatenate([n / max(1, len(tokens)), list(more.values())])))
    y = np.array([kinds.index(g) for g in grades])
    share = np.array([(y > j).mean() for j in range(len(kinds) - 1)])
    raw = -np.log(share / (1 - share))
    gaps = np.concatenate([raw[:1], np.log(np.maximum(np.diff(raw), 1e-2))])  # thresholds: the first, then steps by exp
    w = np.zeros(BUCKETS)
    m, v, mg, vg = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(gaps)), np.zeros(len(gaps))
    level = np.arange(len(kinds) - 1)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch)
        owner = np.repeat(np.arange(batch), [len(rows[p][0]) for p in pick])
        ids, x = np.concatenate([rows[p][0] for p in pick]), np.concatenate([rows[p][1] for p in pick])
        margin = np.bincount(owner, weights=w[ids] * x, minlength=batch)
        thresholds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        above = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds[None, :], -30, 30)))
        own = y[pick]
        # chance of the own grade = above the one below it minus above itself
        up = np.where(own > 0, above[np.arange(batch), np.maximum(own - 1, 0)], 1.0)
        down = np.where(own < len(kinds) - 1, above[np.arange(batch), np.minimum(own, len(kinds) - 2)], 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up), down * (1 - down)
        g = -(d_up - d_down) / p / batch
        grad = np.bincount(ids, weights=g[owner] * x, minlength=BUCKETS) + 1e-5 * w
        g_thresholds = np.array([((own - 1 == j) * d_up / p - (own == j) * d_down / p).sum() / batch for j in level])
        tail = np.cumsum(g_thresholds[::-1])[::-1]
        g_gaps = tail * np.concatenate([[1.0], np.exp(gaps[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mg, vg = 0.9 * mg + 0.1 * g_gaps, 0.99 * vg + 0.01 * g_gaps**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        gaps -= rate * (mg / (1 - 0.9**step)) / (np.sqrt(vg / (1 - 0.99**step)) + 1e-8)
    return Model(kinds, w, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> Model:
    """``allowed``: over the rating table's ids, which rows may be learned from. Only the sample's texts come to the driver."""
    marked = ratings.where(allowed & F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).alias("grade"))
    totals = {r["grade"]: r["count"] for r in marked.groupBy("grade").count().limit(GRADES + 1).collect()}
    if len(totals) > GRADES:
        raise ValueError(f"more than {GRADES} grades")
    if not totals:
        return train([], [])
    shares = docs.sparkSession.createDataFrame([(float(g), min(1.0, SAMPLE / n)) for g, n in totals.items()], "grade double, share double")
    marked = marked.select("id", F.col("grade").cast("double").alias("grade")).join(F.broadcast(shares), "grade")
    wanted = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("id", "grade").limit(2 * SAMPLE * len(totals))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    rows = rows.select(window_of("text", SAMPLE_CHARS).alias("text"), "grade").orderBy(F.xxhash64("text")).limit(3 * SAMPLE * len(totals)).collect()
    rows = sorted((r["text"], r["grade"]) for r in rows)
    return train([t for t, _ in rows], [k for _, k in rows])


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                expected, tail = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["id", "expected_grade", "tail"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "id long, expected_grade double, tail double")
