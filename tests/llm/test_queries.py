"""The registered queries, over small tables with odd rows, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from treadle.llm import queries as Q
from treadle.llm.fingerprints import K

VOCAB = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = {"en": "the ing tion and", "fr": "eau ère ç que", "de": "sch ung ßen und"}
    out = []
    for k in range(90):
        lang = ("en", "fr", "de")[k % 3]
        words = ["".join(rng.choices(word[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(1, 120))]
        out.append((3 * k, " ".join(words) + rng.choice(["", "\nlast line", " "]), lang))
    out += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !?", None), (1003, out[4][1], "en"), (1004, out[5][1] + " x", "en"), (5000, "wörd " * 4000, "de"), (5001, "日本語 " * 50, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    table = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    table.limit(0).write.parquet(f"{place}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/empty/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{place}/empty/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{place}/empty/conversations.parquet")
    return place


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op1(spark, folder, rows):
    got = {r["doc_id"]: r for r in Q.op1_fingerprints(spark, folder).collect()}
    order = sorted(rows)
    prints = {}
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == sha(edited)
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert max(len(a | b), len(a | c)) <= K  # the sketches hold all there is
        assert abs(got[i]["near_edited"] - likeness(a, b)) < 1e-9 and abs(got[i]["near_next"] - likeness(a, c)) < 1e-9
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCAB)
    return {i: whole.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}


def test_op4(spark, folder, ids):
    got, windows = {}, {}
    for r in Q.op4_packing(spark, folder).collect():
        own = [*ids[r["doc_id"]], 0]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in ids.items():
        assert [s for s, _ in sorted(got[i])] == np.cumsum([0, *[n for _, n in sorted(got[i])]])[:-1].tolist()
        assert sum(n for _, n in got[i]) == len(own) + 1
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 1024


def test_op7(spark, folder, ids, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCAB)
    got = {r["doc_id"]: r for r in Q.op7_bpe(spark, folder).collect()}
    for i, _, _ in rows:
        assert got[i]["n_tokens"] == len(ids[i])
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == sha(whole.decode(ids[i], skip_special_tokens=False))


def test_op8(spark, folder, rows):
    got = {r["doc_id"]: r["class_id"] for r in Q.op8_near_dup(spark, folder).collect()}
    sets = {i: shingles(t or "") for i, t, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if a and b and likeness(a, b) >= 0.8:
                assert got[i] == got[j]
    assert got[1003] == got[12] == 12 and len(got) == len(rows)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op3_op5_op10(spark, folder, rows):
    toxic = {r["doc_id"]: r for r in Q.op3_toxicity(spark, folder).collect()}
    lang = {r["doc_id"]: r for r in Q.op5_language(spark, folder).collect()}
    grade = {r["doc_id"]: r for r in Q.op10_quality(spark, folder).collect()}
    right = []
    for i, _, own in rows:
        assert toxic[i]["held_out"] == (fold(i, 5) == 0) and lang[i]["held_out"] == (fold(i, 3) == 1) and grade[i]["held_out"] == (fold(i, 5) == 0)
        assert 0 <= toxic[i]["score"] <= 1 and toxic[i]["predicted"] == int(toxic[i]["score"] >= 0.5)
        assert 0 <= grade[i]["expected_grade"] <= 1 and grade[i]["selected"] == (grade[i]["tail_probability"] >= 0.5)
        if i < 1000 and fold(i, 3) == 1:
            right.append(lang[i]["lang_pred"] == own)
    assert np.mean(right) > 0.8
    assert [lang[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3


def test_queries_of_empty_tables(spark, folder):
    for name, query in Q.queries().items():
        assert query(spark, f"{folder}/empty").count() == 0, name
