"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters two, three and four bytes wide, passed through a rectifier, max-pooled over
a window of WINDOW bytes and given to a softmax; all of it is trained in numpy. A text is cut into windows of fixed length, the last
filled up with zero bytes, and windows of many texts are run in batches. The text's class scores are the mean of its
windows' logits, weighted by their bytes. For speed the trained filters become tables over byte pairs, which give the
same sums.

It is fitted on a bounded sample: about SAMPLE texts of each language, chosen by a hash of id and text, with three windows of
each at places that the hash gives. A fifth of the texts is held out of the training, and the temperature that divides logits is the one
that makes their probabilities likeliest, so a score says how often a prediction is right. Predictions read whole texts.

A null text, or one without a letter, is `und` with score 1; so is every text if there is nothing to learn from (score
0). Repeated rows each get their prediction, equal texts the same; ties go to the language that sorts first. Further
columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadle.llm.common import tidied

SAMPLE = 800
PLACES = 3
#: Learned from at most; more values of the column are an error.
LANGUAGES = 1000
#: Sampled texts from which on some are held out.
LEAST_HELD = 50
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIMS = 8
UNKNOWN = "und"
TEMPERATURES = tuple(float(t) for t in np.geomspace(0.25, 8, 41))


class Network:
    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.kernels = [rng.normal(0, 1 / np.sqrt(w * DIMS), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(n, np.float32)
        self.out = rng.normal(0, 1 / np.sqrt(n), (n, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.temperature = 1.0

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, self.shift, self.out, self.bias]

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 600, batch: int = 96, rate: float = 0.01, seed: int = 2) -> None:
        """windows: (n, WINDOW + 3) bytes. Some are shortened at random, so that short texts are known too."""
        rng = np.random.default_rng(seed)
        means, squares = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            x, y = windows[pick].copy(), labels[pick]
            for k in np.flatnonzero(rng.random(batch) < 0.6):
                x[k, int(4 * (WINDOW / 4) ** rng.random()) :] = 0
            pooled, best = [], []
            for w, kernel in zip(WIDTHS, self.kernels, strict=True):
                conv = sum((self.embed @ kernel[j])[x[:, j : j + WINDOW]] for j in range(w))
                best.append(conv.argmax(1))
                pooled.append(np.take_along_axis(conv, best[-1][:, None, :], 1)[:, 0])
            hidden = np.concatenate(pooled, 1) + self.shift
            active = np.maximum(hidden, 0)
            logits = active @ self.out + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), y] -= 1
            p /= batch
            d_hidden = (p @ self.out.T) * (hidden > 0)
            d_embed, d_kernels = np.zeros_like(self.embed), []
            for i, (w, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
                d = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                d_kernel = np.zeros_like(kernel)
                for j in range(w):
                    byte = np.take_along_axis(x, best[i] + j, 1)
                    d_kernel[j] = np.einsum("bfd,bf->df", self.embed[byte], d)
                    np.add.at(d_embed, byte.ravel(), (d[:, :, None] * kernel[j].T[None]).reshape(-1, DIMS))
                d_kernels.append(d_kernel)
            d_embed[0] = 0
            for p_, m, v, g in zip(self.params(), means, squares, [d_embed, *d_kernels, d_hidden.sum(0), active.T @ p, p.sum(0)], strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, from TEMPERATURES, with the least mean log loss."""

    def loss(t: float) -> float:
        x = logits / t - (logits / t).max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]))

    return min(TEMPERATURES, key=loss)


class Tables:
    """The filters as sums over pairs of bytes: the pair at a place, and the pair two further on."""

    def __init__(self, net: Network):
        self.net = net
        one = [[net.embed @ k[j] for j in range(len(k))] for k in net.kernels]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        zero = np.zeros((256, FILTERS), np.float32)
        self.here = np.ascontiguousarray(np.concatenate([pair(*one[0]), pair(*one[1][:2]), pair(*one[2][:2])], 1))
        self.ahead = np.ascontiguousarray(np.concatenate([pair(one[1][2], zero), pair(*one[2][2:])], 1))

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """rows: (n, WINDOW + 3) bytes, each window with the three that follow it in its text."""
        out = np.empty((len(rows), len(self.net.classes)), np.float32)
        for k in range(0, len(rows), 64):
            wide = rows[k : k + 64].astype(np.uint16)
            pairs = (wide[:, :-1] << 8) | wide[:, 1:]
            conv = self.here[pairs[:, :WINDOW]]
            conv[:, :, FILTERS:] += self.ahead[pairs[:, 2:]]
            hidden = conv.max(1) + self.net.shift
            out[k : k + 64] = np.maximum(hidden, 0) @ self.net.out + self.net.bias
        return out

    def predict(self, texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
        """The class and its probability for each text, given as bytes."""
        sizes = np.array([len(t) for t in texts])
        counts = np.maximum(1, -(-sizes // WINDOW))
        first = np.cumsum(counts) - counts
        rows = np.zeros((int(counts.sum()), WINDOW + 3), np.uint8)
        for t, k, n in zip(texts, first, counts, strict=True):
            own = np.zeros(n * WINDOW + 3, np.uint8)  # no byte of another text follows
            own[: len(t)] = np.frombuffer(t, np.uint8)
            rows[k : k + n] = np.lib.stride_tricks.as_strided(own, (n, WINDOW + 3), (WINDOW, 1))
        logits = self.logits(rows).astype(np.float64)
        place = np.arange(counts.sum()) - np.repeat(first, counts)
        weight = np.clip(np.repeat(sizes, counts) - place * WINDOW, 0, WINDOW).astype(np.float64)
        total = np.add.reduceat(logits * weight[:, None], first) / np.maximum(np.add.reduceat(weight, first), 1)[:, None]
        total /= self.net.temperature
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def window_bytes(text: str) -> np.ndarray:
    out = np.zeros(WINDOW + 3, np.uint8)
    raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
    out[: len(raw)] = raw
    return out


def fit(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """``allowed``: which rows may be learned from. Only the sample's windows come to the driver."""
    known = docs.where(allowed).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not totals:
        return None
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE / n)) for k, n in totals.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30))
    wanted = known.join(F.broadcast(shares), "lang").where(chance < F.col("share") * (1 << 30))
    places = [F.substring("text", 1 + F.pmod(F.xxhash64(F.lit(j), "id"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int"), F.lit(WINDOW)) for j in range(PLACES)]
    rows = wanted.select("lang", F.array(*places).alias("windows"), chance.alias("chance")).orderBy("chance").limit(2 * SAMPLE * len(totals)).collect()
    rows = sorted((tuple(r["windows"]), r["lang"]) for r in rows)
    net = Network(sorted(totals))
    code = lambda part: (np.stack([window_bytes(w) for ws, _ in part for w in ws]), np.repeat([net.classes.index(k) for _, k in part], PLACES))
    apart = [k % 5 == 0 for k in range(len(rows))] if len(rows) >= LEAST_HELD else [False] * len(rows)
    net.train(*code([r for r, out in zip(rows, apart, strict=True) if not out]))
    if any(apart):
        windows, labels = code([r for r, out in zip(rows, apart, strict=True) if out])
        net.temperature = calibrated(Tables(net).logits(windows).astype(np.float64), labels)
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The text itself goes no further than the worker."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary")).alias("raw"))
    if net is None:
        return plain.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(net)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores = labels_of(part.column(1), tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return plain.mapInArrow(tidied(run), "id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter and a score of at least ``least``, with all their columns; all rows, where no language was learned."""
    if net is None:
        return docs
    at = docs.columns.index(text_col)
    letters = docs.where(F.col(text_col).rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(net)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                _, scores = labels_of(part.column(at).cast(pa.binary()), tables)
                yield part.filter(pa.array(np.array(scores) >= least))

    return letters.mapInArrow(tidied(run), docs.schema)


def labels_of(column: pa.Array, tables: Tables) -> tuple[list[str], list[float]]:
    texts = [x.as_buffer() if x.is_valid else None for x in column]
    known = [i for i, t in enumerate(texts) if t is not None]
    langs, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
    if known:
        best, p = tables.predict([texts[i] for i in known])
        for i, c, s in zip(known, best.tolist(), p.tolist(), strict=True):
            langs[i], scores[i] = tables.net.classes[c], s
    return langs, scores
