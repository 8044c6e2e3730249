import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treadle.llm import bpe, packing, topk

VOCAB = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, sequence_id int"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def test_character_tables_agree(whole):
    code = bpe.codec(VOCAB)
    for point in range(0x250):
        c = chr(point)
        for text in (c, f"a{c}b", f" {c}", f"{c} {c}", f"1{c}2", f"{c}{c}  {c}a"):
            assert code.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, (point, text)


def test_chunks_equal_whole_texts(whole):
    random.seed(3)
    parts = [*"ab  \n\t'1.", "é", "日本", "🙂", " word", "'s", "<|endoftext|>", "   "]
    encoder = bpe.ChunkEncoder(VOCAB, keep=20_000)
    for size in (0, 1, 40, 900, 6000):
        for _ in range(12):
            text = "".join(random.choices(parts, k=size))
            assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    for text in ("x" * 50_000, " " * 30_000, "\n " * 9000 + "z", "日" * 20_000):
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_shared_passages_are_encoded_once():
    random.seed(5)
    passage = " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(6000))
    encoder = bpe.ChunkEncoder(VOCAB)
    encoder.encode("one " + passage)
    before = encoder.encoded
    encoder.encode("quite another beginning, " + passage)
    assert encoder.reused > 5 and encoder.encoded - before < 5


def test_encode_decode_rows(spark, whole):
    rows = [(1, "Hello <|endoftext|> it's", "x", 1), (2, None, "x", 2), (2, "", None, 3), (None, "é 日", "x", 1), (1, "Hello <|endoftext|> it's", "x", 1)]
    got = sorted((r["id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.encode_decode(spark.createDataFrame(rows, DOCS), VOCAB).collect())
    want = sorted((i or -1, ids := whole.encode(t or "", add_special_tokens=False).ids, whole.decode(ids, skip_special_tokens=False)) for i, t, *_ in rows)
    assert got == want
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), VOCAB).count() == 0


def test_packing_covers_every_token_once(spark, whole):
    random.seed(7)
    rows = [(k, " ".join("".join(random.choices("abcdef", k=5)) for _ in range(random.choice([0, 3, 40, 700, 3000]))), "x", 0) for k in range(60)]
    rows += [(60, None, None, 0), (None, "tail", "x", 0), (5, rows[5][1], "x", 0)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).coalesce(1), VOCAB).collect()
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r["id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc, text, *_ in rows:
        if doc != 5:
            assert sum((ids for _, ids in sorted(pieces[doc])), []) == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
    total = sum(r["length"] for r in got)
    assert len(windows) <= -(-total // packing.WINDOW) + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), VOCAB).count() == 0


def test_best_fit_takes_the_tightest_window():
    random.seed(11)
    lengths = [random.randint(1, 250) for _ in range(400)]
    packer = packing.Packer(100, 0)
    placed = packer.place(lengths)
    rooms, used = [], {}
    for n in sorted((x % 100 for x in lengths if x % 100), reverse=True):  # brute force over all open windows
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 100) - n)
    for k, start, s, offset in placed:
        used[s] = max(used.get(s, 0), offset + min(100, lengths[k] - start))
    assert sorted(100 - u for u in used.values() if u < 100) == sorted(r for r in rooms if r)


def test_packing_crc(spark):
    df = packing.pack_documents(spark.createDataFrame([(1, "some words", "x", 0)], DOCS), VOCAB).select("ids", F.crc32("ids").alias("c")).first()
    assert df["c"] == zlib.crc32(bytes(df["ids"]))


def brute(rows, k):
    held = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in set(held):
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in held if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_top_k_is_exact(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 20))
    rows = [(k, [float(x) for x in (centres[k % 6] + 0.2 * rng.normal(size=20)).astype(np.float32)]) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 330)]  # ties
    rows += [(400, None), (405, [None] * 20), (410, [float("nan")] * 20), (None, rows[1][1]), (415, rows[2][1][:7]), (420, []), (0, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    if not broadcast:
        monkeypatch.setattr(topk, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in (rng.normal(size=6) * size).astype(np.float32)]) for k, size in enumerate([1, 300_000, 1e6] * 20)]
    rows += [(100, [1e12, 0.0, 1.0]), (101, [0.0, 3e12, 5.0]), (105, [1e12, 1e12, -2.0]), (110, [-1e12, -1e12, 7.0]), (102, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    some = df.where("vec_id <> 105 and vec_id <> 110")
    left = [r for r in rows if r[0] not in (105, 110)]
    got = sorted(tuple(r) for r in topk.top_k(some, F.col("vec_id") % 5 == 0, k=10).collect())
    assert got == brute(left, 10)
    with pytest.raises(Exception, match="OVERFLOW"):  # 105 with 100
        topk.top_k(df, F.col("vec_id") % 5 == 0, k=10).collect()


def test_bounds_prune_pairs():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 64)) * 3
    x = np.floor(1024 * (np.repeat(centres, 400, axis=0) + 0.1 * rng.normal(size=(3200, 64)))).astype(np.int32)
    best = topk.Best(np.arange(0, 3200, 400), x[::400], 10)
    best.add(np.arange(3200), x)
    assert best.exact_pairs < 0.5 * best.pairs
    rng = np.random.default_rng(3)  # without any structure only the last bounds prune
    x = np.floor(1024 * rng.normal(size=(8000, 64)) / 8)
    best = topk.Best(np.arange(0, 8000, 400), x[::400], 10)
    best.add(np.arange(8000), x)
    assert best.exact_pairs < 0.5 * best.pairs


def test_packing_follows_no_file_layout(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices(["some", "words", "of", "text"], k=rng.randint(1, 700))), "x", 0) for k in range(600)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(60), VOCAB)
    fills = [r["n"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(fills) / (packing.WINDOW * len(fills)) > 0.99 and max(fills) <= packing.WINDOW
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got.collect())
    at = {}
    for s, offset, n in places:
        assert offset == at.get(s, 0)
        at[s] = offset + n
