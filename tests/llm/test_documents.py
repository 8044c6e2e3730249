import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treadle.llm import chat, fingerprints, language, line_dedup, near_dup, quality, toxicity

DOCS = "doc_id long, text string, lang string, n_removed string, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], DOCS)


def word_shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def invented(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


# ---- fingerprints


def test_sketches_estimate_resemblance_and_merge(spark):
    rng = random.Random(1)
    base = invented(rng, 3000)
    pairs = [(" ".join(base), " ".join(base[:2400] + invented(rng, 600))), ("one two", "one two"), ("", None), ("one", ""), ("A, b! c d e f", "a b c d e f")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    s, t = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    rows = df.select("k", s.alias("s"), t.alias("t")).select("*", fingerprints.resemblance(F.col("s"), F.col("t")).alias("r"), fingerprints.containment(F.col("s"), F.col("t")).alias("c"), fingerprints.distinct_shingles(F.col("s")).alias("n")).orderBy("k").collect()
    a, b = word_shingles(pairs[0][0]), word_shingles(pairs[0][1])
    assert abs(rows[0]["r"] - len(a & b) / len(a | b)) < 0.1
    assert abs(rows[0]["c"] - len(a & b) / len(a)) < 0.12
    assert abs(rows[0]["n"] / len(a) - 1) < 0.25
    assert [r["r"] for r in rows[1:]] == [1.0, 1.0, 0.0, 1.0]
    parts = spark.createDataFrame([(1, " ".join(base[:1500])), (1, " ".join(base[1496:])), (2, "")], "g int, text string").select("g", fingerprints.sketch(F.col("text")).alias("sketch"))
    assert fingerprints.merged_sketches(parts, ["g"]).where("g = 1").first()["sketch"] == rows[0]["s"]


@pytest.mark.parametrize("ids", [range(30), [5, -3, 9000, 4097, 4096, 123456789, 40960, 8191], [3], [*range(100), *(k * 10**15 - 2**62 for k in range(100))]])
@pytest.mark.parametrize(("span", "step"), [(1024, 64), (3, 4)])
def test_next_documents(spark, monkeypatch, ids, span, step):
    monkeypatch.setattr(fingerprints, "SPAN", span)
    monkeypatch.setattr(fingerprints, "STEP", step)
    rows = [(i, f"text of {i}") for i in ids]
    found = fingerprints.with_next(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r["id"]: (r["next_text"], r["next_sketch"]) for r in found}
    order = sorted(ids)
    sketches = {r["id"]: r["sketch"] for r in found}
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        assert got[i] == (f"text of {after}", sketches[after])


def test_next_documents_of_odd_rows(spark):
    rows = [(1, "b"), (1, "a"), (None, "lost"), (2, None), (1, "a")]
    got = [(r["id"], r["text"], r["next_text"]) for r in fingerprints.with_next(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", "a"), (1, "a", "b"), (1, "b", ""), (2, "", "a"), (None, "lost", "")], key=str)
    assert fingerprints.with_next(docs(spark, [])).count() == 0


# ---- line dedup


def brute_lines(rows):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(x.strip(" ").lower() for x in lines[k : k + 3])
            if any(w):
                if w in seen:
                    gone.setdefault(i, set()).update(range(k, k + 3))
                seen.add(w)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    lines = ["A b", "c", "", " d ", "e e", "f"]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for k in range(60)] + [(100, "\n" * 50), (101, "x\n" * 5000)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_a_long_text_is_linear(spark):
    text = "\n".join(f"l{k % 60_000}" for k in range(120_000))
    row = line_dedup.dedup_lines(docs(spark, [(1, text)])).first()
    assert (row["n_lines"], row["n_removed"], row["text"]) == (120_000, 59_998 + 2, "\n".join(f"l{k}" for k in range(60_000)))


def test_line_dedup_odd_rows(spark):
    rows = [(2, "p\nq\nr\ns"), (2, "p\nq\nr\ns"), (3, None), (None, "z\np\nq\nr"), (4, "p\nq"), (5, "P\nq \nR\nend")]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "lang", "id", "text", "n_lines", "n_removed"]
    found = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str)
    assert found == sorted([(None, "z\np\nq\nr", 0), (2, "s", 3), (2, "s", 3), (3, None, 0), (4, "p\nq", 0), (5, "end", 3)], key=str)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# ---- near-duplicates


def brute_classes(rows):
    ids = sorted(i for i, _ in rows)
    sets = {i: word_shingles(t) for i, t in rows}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text = dict(rows)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            same = not a and not b and (text[i] or "").strip(" ") == (text[j] or "").strip(" ")
            if same or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for size, copies, edits in ((80, 40, 3), (60, 30, 2), (120, 12, 5), (9, 4, 1), (3, 3, 0)):
        base = invented(rng, size)
        for _ in range(copies):  # without the text they come from
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = invented(rng, 1)[0]
            if rng.random() < 0.3:
                words = words[: max(2, len(words) * rng.randint(70, 100) // 100)]
            rows.append(" ".join(words))
    common = invented(rng, 50)
    rows += [" ".join(invented(rng, rng.randint(10, 60)) + common) for _ in range(30)]
    rows += ["For " * 300 + " ".join(invented(rng, 60)) for _ in range(6)] + [None, "", "...", " ... ", "!!!", "word", "Word."]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (2, "A b, c d e f g!"), (9, None), (8, "")]
    found = near_dup.near_duplicates(docs(spark, rows))
    assert sorted(tuple(r) for r in found.select("id", "copy_of", "class_id").collect()) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (8, 8, 8), (9, 8, 8)]
    kept = near_dup.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "n_removed", "id"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 8]
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0 and near_dup.keep_one(docs(spark, [])).count() == 0


def test_different_texts_under_one_id_are_kept_apart(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, "alone"), (5, b), (None, a)]
    found = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == 7 and len({(r["class_id"], r["class_text"]) for r in found}) == 3
    assert sorted((r["id"], r["copy_of"], r["class_id"]) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 4, 4), (5, 1, 1)]
    kept = near_dup.keep_one(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, a), (1, a), (1, b), (4, "alone")])
    rows = [(3, b), (3, b), (3, b.upper()), (4, a), (4, a)]
    kept = [sorted(tuple(r) for r in near_dup.keep_one(docs(spark, rows[::way])).collect()) for way in (1, -1)]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_slots_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    a, b = x[:300], x[100:]
    wa, wb = 1 + rng.random(len(a)) * 3, 1 + rng.random(len(b)) * 3
    own = near_dup.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], [len(a), len(b)]), 2, slots=4000)
    want = near_dup.probability_jaccard(dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True)))
    assert abs((own[0] == own[1]).mean() - want) < 0.04


def test_similarities_equal_their_definitions():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        a, b = np.sort(rng.permutation(x)[:40]), np.sort(rng.permutation(x)[:45])
        na, nb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        jaccard, probability, hit = near_dup.similarities(a, na, b, nb)
        want = near_dup.probability_jaccard(dict(zip(a.tolist(), na.tolist(), strict=True)), dict(zip(b.tolist(), nb.tolist(), strict=True)))
        common = len({*a.tolist()} & {*b.tolist()})
        assert abs(probability - want) < 1e-9 and jaccard == common / (len(a) + len(b) - common) and hit.sum() == common


def star_rows(centre, members):
    """What verification says of members of a centre; sets are dicts of weights."""
    out = []
    for k, x in enumerate(members):
        more = {e: n for e, n in x.items() if e not in centre}
        out.append(((0, 0), (k + 1, 0), 0.0, 0.0, len(x), len(x) - len(more), sum(x.values()), sum(x.values()) - sum(more.values()), list(more), list(more.values())))
    return out


@pytest.mark.parametrize("weights", [[1], [1, 1, 2, 9, 40]])
def test_groups_lose_no_link(spark, weights):
    rng = random.Random(9)
    weight = lambda keys: {k: rng.choice(weights) for k in keys}
    centre, members = set(range(40)), []
    common = rng.sample(range(500, 600), 12)  # popular, but not with the centre
    for group in range(60):
        own = rng.sample(range(100, 140), rng.randint(0, 20)) + rng.sample(common, rng.choice([0, 0, 10, 12])) if group % 3 else []
        x = weight([*rng.sample(range(40), rng.randint(10, 40)), *own])
        members.append(x)
        for _ in range(2):
            y = {k: max(1, n + rng.randint(-1, 1)) if len(weights) > 1 else 1 for k, n in x.items() if rng.random() < 0.97}
            members.append(y | dict.fromkeys(rng.sample(range(1000, 2000), rng.randint(0, 3)), 1))
    stars = spark.createDataFrame(star_rows(centre, members), f"a {near_dup.KEY}, b {near_dup.KEY}, jaccard double, probability double, size long, common long, mass long, held long, extra array<bigint>, weight array<bigint>")
    roots = spark.createDataFrame([], f"id {near_dup.KEY}, root {near_dup.KEY}")
    groups = near_dup.stored(near_dup.groups_of(stars, roots))
    met = groups.alias("x").join(groups.alias("y"), near_dup.GROUP).where("x.b.id < y.b.id").where(near_dup.possible("x", "y", F.col("within")))
    met = {(r[0], r[1], r[2]) for r in met.select("x.b.id", "y.b.id", "within").collect()}
    links = {True: 0, False: 0}
    for i, x in enumerate(members):
        for j, y in enumerate(members[:i]):
            same = x.keys() & y.keys()
            if max(len(same) / len(x.keys() | y.keys()), near_dup.probability_jaccard(x, y)) >= 0.8:
                within = same <= centre
                links[within] += 1
                assert (j + 1, i + 1, within) in met
    assert links[False] > 30 and links[True] > 0
    assert len({p[:2] for p in met}) < len(members) * (len(members) - 1) / 4


def test_members_meet_once_and_where_enough_follows(spark):
    centre, popular, members = set(range(40)), range(50, 58), []
    for family in range(12):  # of three that differ in one element each; families share the popular ones, too few for a link
        for k in range(3):
            members.append(dict.fromkeys([*range(10), *popular, *range(100 + 5 * family, 103 + 5 * family), 1000 + 3 * family + k], 1))
    stars = spark.createDataFrame(star_rows(centre, members), f"a {near_dup.KEY}, b {near_dup.KEY}, jaccard double, probability double, size long, common long, mass long, held long, extra array<bigint>, weight array<bigint>")
    groups = near_dup.stored(near_dup.groups_of(stars, spark.createDataFrame([], f"id {near_dup.KEY}, root {near_dup.KEY}")))
    met = groups.alias("x").join(groups.alias("y"), near_dup.GROUP).where("x.b.id < y.b.id").where(near_dup.possible("x", "y", F.col("within")))
    met = sorted(tuple(r) for r in met.select("x.b.id", "y.b.id").collect())
    assert met == [(3 * f + i, 3 * f + j) for f in range(12) for i, j in ((1, 2), (1, 3), (2, 3))]


def test_near_duplicates_link_by_weight(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for group in range(12):
        passage = invented(rng, 200) * 3  # weight in common 0.83, set Jaccard 0.66
        for k in range(2):
            rows.append((2 * group + k, " ".join(passage + invented(rng, 50))))
            want[2 * group + k] = 2 * group
    assert max(len(a & b) / len(a | b) for a, b in [(word_shingles(rows[k][1]), word_shingles(rows[k + 1][1])) for k in range(0, 24, 2)]) < 0.8
    assert {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == want


def test_near_duplicates_name_their_links(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(6)]
    found = near_dup.near_duplicates(docs(spark, rows))
    assert found.columns == ["id", "copy_of", "class_id", "class_text", "verified_links"]
    assert all(r["class_id"] == 0 and 1 <= r["verified_links"] <= 5 for r in found.collect())


def test_near_duplicates_meet_in_spite_of_repeats(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):  # set Jaccard 0.85, probability Jaccard 0.1
        words = invented(rng, 60)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + invented(rng, 6) * 100))]
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def shingle_weights(text):
    words = text.split()
    out = {}
    for k in range(len(words) - 4):
        out[tuple(words[k : k + 5])] = out.get(tuple(words[k : k + 5]), 0) + 1
    return out


def test_weighted_links_around_a_centre_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for n in (30, 60):
        passage = invented(rng, n)
        for own in (20, 30, 30, 40, 40, 60):
            extra = invented(rng, own)
            rows += [" ".join(passage * rng.randint(3, 5) + extra), " ".join(passage * 4 + extra[: own * 2 // 3] * rng.randint(1, 2))]
    rows = list(enumerate(rows))
    sets, text = {i: word_shingles(t) for i, t in rows}, {i: shingle_weights(t) for i, t in rows}
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    root = {i: i for i, _ in rows}
    for i in root:
        for j in root:
            if i < j and (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 or near_dup.probability_jaccard(text[i], text[j]) >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert got == root


# ---- classifiers


def insults(rng, n, roots, share):
    out = []
    for k in range(n):
        words = invented(rng, rng.randint(5, 60))
        if k % 2:
            for _ in range(max(1, int(share * len(words)))):
                words[rng.randrange(len(words))] = rng.choice(roots) + rng.choice(["", "er", "ing", "xx", "k", "y"])
        out.append((k, " ".join(words), k % 2))
    return out


def test_toxicity_learns_and_knows_misspellings(spark):
    rng = random.Random(7)
    roots = ["zorgle", "vlimp", "quaxxot"]
    rows = insults(rng, 500, roots, 0.05)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "..."), (None, "zorgle")])
    model = toxicity.fit(table, labels, F.col("doc_id") % 5 != 0)
    got = {r["id"]: r["score"] for r in toxicity.score(table, model).collect()}
    held = [(y, got[i]) for i, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for y, s in held) / len(held) > 0.93
    assert got[1000] == got[1001] == got[1002] < 0.5
    scores = toxicity.Scorer(model).scores(["so zorgles here", "so quaxxots you are", " ".join(invented(rng, 20000)) + " vlimped", "plain words"])
    assert min(scores[:3]) > 0.5 > scores[3]
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.score(table.limit(0), toxicity.fit(table.limit(0), labels.limit(0), F.lit(True))).count() == 0


def test_language_learns_and_defines_the_rest(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "eit"], "cc": ["ção", "nhé", "lü"]}
    rows = [(k, " ".join("".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(rng.randint(3, 300))), lang) for k in range(240) for lang, s in [list(sounds.items())[k % 3]]]
    table = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !?", "aa"), (502, "ungeit", None), (None, "kato", "aa")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    net = language.fit(table, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False)))
    assert net.classes == ["aa", "bb", "cc"]
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.predict(table, net).collect()}
    held = [(lang, got[i][0]) for i, _, lang in rows if i % 4 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert got[500] == got[501] == ("und", 1.0) and all(0 <= s <= 1 for _, s in got.values())
    kept = {r["doc_id"] for r in language.keep_known(table, net).collect()}
    assert 500 not in kept and 501 not in kept and len(kept) > 230
    assert {r["lang_pred"] for r in language.predict(table, language.fit(table, F.lit(False))).collect()} == {"und"}
    assert language.keep_known(table, None).count() == table.count()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert abs(language.calibrated(logits * 3, labels) / 3 - 1) < 0.15


def test_language_scores_equal_plain_windows(spark):
    net = language.Network(["x", "y", "z"])
    rng = random.Random(4)
    rows = [(k, "a" + "".join(rng.choices("abc ñß", k=n))) for k, n in enumerate([1, 5, 255, 256, 257, 700, 2000])]
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs(spark, rows), net).collect()}
    for k, text in rows:
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            own = np.frombuffer((raw[at : at + language.WINDOW + 3] + b"\0" * (language.WINDOW + 3))[: language.WINDOW + 3], np.uint8)
            pooled = [np.max([sum(net.embed[own[t + j]] @ kernel[j] for j in range(w)) for t in range(language.WINDOW)], axis=0) for w, kernel in zip(language.WIDTHS, net.kernels, strict=True)]
            logits = np.maximum(np.concatenate(pooled) + net.shift, 0) @ net.out + net.bias
            total += logits * min(language.WINDOW, len(raw) - at)
        p = np.exp(total / len(raw)) / np.exp(total / len(raw)).sum()
        assert got[k][0] == net.classes[int(p.argmax())] and abs(got[k][1] - p.max()) < 1e-4


def test_toxicity_scores_equal_plain_averages():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.3)
    texts = ["one two three", "", "solo", "a b " * 500 + "rare", "Ünï çode, words! here"]
    for text, score in zip(texts, toxicity.Scorer(model).scores(texts), strict=True):
        own = toxicity.words(text)
        values = [float(np.mean([model.along[b] for b in toxicity.subwords([w])[0]])) for w in own]
        parts = [np.mean(values[k : k + toxicity.SEGMENT_WORDS]) for k in range(0, len(values), toxicity.SEGMENT_WORDS)]
        weights = [np.exp(toxicity.SHARPNESS * p) for p in parts]
        margin = sum(w * p for w, p in zip(weights, parts, strict=True)) / sum(weights) if parts else 0.0
        assert abs(score - 1 / (1 + np.exp(-margin + 0.3))) < 1e-6


def test_quality_scores_equal_plain_sums():
    rng = np.random.default_rng(6)
    model = quality.Model([0.0, 0.5, 2.0], rng.normal(size=quality.BUCKETS), np.array([-0.5, 0.7]))
    texts = ["One two two 33!", None, "  ", "x\ny"]
    for k, (expected, tail) in enumerate(zip(*quality.Scorer(model).scores(texts), strict=True)):
        tokens = (texts[k] or "").split()
        margin = sum(model.weights[f] for t in tokens for f in quality.token_features(t)) / max(1, len(tokens))
        margin += sum(model.weights[f] * x for f, x in quality.text_features(texts[k]).items())
        above = [1 / (1 + np.exp(-(margin - t))) for t in model.thresholds]
        assert abs(expected - (above[0] * 0.5 + above[1] * 1.5)) < 1e-9 and abs(tail - above[1]) < 1e-9


def test_tables_equal_plain_convolution():
    net = language.Network(["x", "y"])
    raw = np.random.default_rng(9).integers(1, 256, 2 * language.WINDOW, dtype=np.uint8)
    flat = np.concatenate([raw, np.zeros(3, np.uint8)])
    rows = np.stack([flat[k * language.WINDOW : (k + 1) * language.WINDOW + 3] for k in range(2)])
    got = language.Tables(net).logits(rows)
    for k, own in enumerate(rows):
        pooled = [np.max([sum(net.embed[own[t + j]] @ kernel[j] for j in range(w)) for t in range(language.WINDOW)], axis=0) for w, kernel in zip(language.WIDTHS, net.kernels, strict=True)]
        assert np.allclose(got[k], np.maximum(np.concatenate(pooled) + net.shift, 0) @ net.out + net.bias, atol=1e-4)


def test_quality_reads_whole_tokens():
    long = "a" * 100
    assert quality.token_features(long + "b")[0] != quality.token_features(long + "c")[0]
    assert quality.shape(long + "9BC") == "a9A" and quality.token_features(long)[1] != quality.token_features(long + "9")[1]


def test_quality_has_ordered_thresholds(spark):
    rng = random.Random(10)
    rows = []
    for k in range(450):
        words = invented(rng, rng.randint(10, 80))
        grade = k % 3
        bad = {0: 0.9, 1: 0.45, 2: 0.0}[grade]
        rows.append((k, " ".join(w + "###" if rng.random() < bad else w for w in words), grade))
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, "")])
    ratings = spark.createDataFrame([(i, g, "x") for i, _, g in rows], "doc_id long, quality int, text string")
    model = quality.fit(table, ratings, F.col("doc_id") % 5 != 0)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r["id"]: (r["expected_grade"], r["tail"]) for r in quality.grade(table, model).collect()}
    held = [(g, *got[i]) for i, _, g in rows if i % 5 == 0]
    means = [np.mean([e for g, e, _ in held if g == k]) for k in range(3)]
    assert means[0] < 0.6 < means[1] < 1.5 < means[2]
    assert sum(round(e) == g for g, e, _ in held) / len(held) > 0.85
    assert got[900] == got[901] and all(0 <= e <= 2 and 0 <= t <= 1 for e, t in got.values())
    assert quality.grade(table.limit(0), quality.fit(table.limit(0), ratings.limit(0), F.lit(True))).count() == 0


# ---- chat


def test_quotes_link_messages(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has ten items."),
        (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."),
        (1, 2, "user", "> Use sorted().\nIn place, I mean."),
        (1, 3, "user", "A wrote:\n> How  do I SORT a list?\n> It has ten items.\nWhich language?"),
        (1, 4, "assistant", ">> How do I sort a list?\n>> It has ten items.\n> Which language?\nPython."),
        (1, 5, "user", "> never said\nThanks."),
        (2, 0, None, None),
        (2, 1, "user", "> Use sorted().\n"),
        (None, 3, "user", "lost"),
        (3, None, "user", "> lost\ntoo"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("branch", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.chat_messages(table).collect()}
    assert [(got[1, t]["reply_to"], got[1, t]["linked"], got[1, t]["branch"], got[1, t]["position"]) for t in range(6)] == [
        (None, False, 0, 0), (0, False, 0, 1), (1, True, 0, 2), (0, True, 3, 0), (3, True, 3, 1), (4, False, 3, 2)
    ]
    assert got[1, 3]["content"] == "Which language?" and got[1, 4]["quote_depth"] == 2
    assert got[2, 0]["formatted"] == "<|unknown|>\n\n<|end|>" and got[2, 1]["reply_to"] == 0 and not got[2, 1]["linked"]
    assert got[None, 3]["branch"] is None and got[3, None]["content"] == "too"
    assert chat.chat_messages(table.limit(0)).count() == 0


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rng = random.Random(11)
    rows = [(1, t, "user", f"line {rng.randint(0, 5)}" if rng.random() < 0.5 else f"> line {rng.randint(0, 5)}\nown {t}") for t in range(60)] + [(1, 7, "user", "again")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = sorted(tuple(map(str, r)) for r in chat.chat_messages(table).collect())
    monkeypatch.setattr(chat, "SPAN", 1000)
    assert small == sorted(tuple(map(str, r)) for r in chat.chat_messages(table).collect())
