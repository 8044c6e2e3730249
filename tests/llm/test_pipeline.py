import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treadle.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    place = str(tmp_path_factory.mktemp("tables"))
    word = {"en": ["the", "ing", "tion"], "de": ["sch", "ung", "ßen"]}
    rows, marks = [], []
    for k in range(160):
        lang = ("en", "de")[k % 2]
        words = ["".join(rng.choices(word[lang], k=rng.randint(1, 4))) + str(rng.randint(0, 9)) for _ in range(rng.randint(20, 90))]
        if k % 8 == 3:
            words[5:8] = ["zorglex", "zorgley", "zorglez"]
        rows.append((k, " ".join(words), lang, f"s{k % 3}", 0))
        marks.append((k, 1, int(k % 8 == 3)))
    rows += [(300, rows[0][1], "en", "s0", 0), (301, rows[2][1] + " tail", "en", "s0", 0), (302, "12345 !!", "en", "s0", 0), (303, None, "en", "s0", 0)]
    shared = "\n".join(f"shared line {k} of the passage" for k in range(4))
    rows += [(310, "the thing ing tion here\n" + shared, "en", "s1", 0), (311, "quite the other tion ing\n" + shared + "\nthe last ing", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == COLUMNS, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, language, lines, near = kept
    assert not any("zorgle" in (t or "") for t in toxic.values()) and len(toxic) >= 140
    assert 302 not in language and 303 not in language and set(toxic) - set(language) <= {302, 303}
    assert set(lines) == set(language) and lines[311] == "quite the other tion ing\nthe last ing"
    assert near.keys() == set(lines) - {300, 301}


def test_run_packs_what_is_left(spark, folder):
    pytest.importorskip("public_tokenizers")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    total = out.agg(F.sum("length"), F.count_distinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert total[2] <= packing.WINDOW and total[1] <= total[0] // packing.WINDOW + 4


def test_stages_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(n))
    long, other = words(30_000), words(40)
    rows = [(1, long), (1, other), (2, other), (2, other), (3, other.upper()), (None, words(20)), (4, ""), (5, None)]
    schema = "doc_id long, text string, lang string, n_chars long, n_lines string, n_removed int, id string, row string"
    spark.createDataFrame([(i, t, None, None, "x", 7, "y", "z") for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        assert {tuple(r[4:]) for r in docs.collect()} == {("x", 7, "y", "z")}, name
        if name == "line_dedup":
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(rows, key=str)
    # nothing to learn from, so nothing goes but copies: of the same words under any id, and of no words
    assert sorted(((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect())) == sorted([(0, len(rows[5][1])), (1, len(long)), (1, len(other)), (4, 0)])
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_equals_plain_decisions(spark, folder):
    """Each stage's rows against the operators' scores taken one text at a time, and against sets of lines and shingles."""
    from treadle.llm import language, toxicity
    from treadle.llm.common import table

    docs = table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.fit(docs, table(spark, folder, "labels"), F.col("doc_id").isNotNull()))
    clean = {i: t for i, t in texts.items() if scorer.scores([t])[0] < corpus_pipeline.TOXIC}
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["toxicity"](spark, docs, folder).cache()
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean
    tables = language.Tables(language.fit(docs, F.lit(True)))
    known = {i: t for i, t in clean.items() if t and any(c.isalpha() for c in t) and tables.predict([t.encode()])[1][0] >= corpus_pipeline.KNOWN}
    docs = stage["language"](spark, docs, folder).cache()
    assert {r["doc_id"] for r in docs.collect()} == set(known)
    seen, cut = set(), {}
    for i, t in sorted(known.items()):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(x.strip(" ").lower() for x in lines[k : k + 3])
            gone |= set(range(k, k + 3)) if window in seen else set()
            seen.add(window)
        cut[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    docs = stage["line_dedup"](spark, docs, folder).cache()
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == cut
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.lower().replace("\n", " ").split()] for k in range(max(1, len(w) - 4))} for i, t in cut.items()}
    kept = set(cut)
    for i in sorted(cut):
        kept -= {j for j in cut if j > i and i in kept and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
    docs = stage["near_dup"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == kept
