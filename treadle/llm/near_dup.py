"""Near-duplicate documents by ProbMinHash, banding and verification.

A text's words are those of the fingerprints (runs of letters, marks and digits, lower case); its elements are five-word
shingles (all words, if fewer), weighted by how often they occur. Each element sends arrivals of a Poisson process
with its weight as rate into SLOTS slots, from a generator seeded by the element alone; a slot keeps the element that
arrives first, and an element ends once its next arrival is later than every slot's. The share of equal slots
estimates the probability Jaccard similarity. BANDS groups of ROWS slots are hashed; a text in which an element repeats
has as many bands again from weights of 1, whose slots estimate the set Jaccard similarity. Texts that share a band are
candidates: a pair of similarity s by either measure is missed with chance (1 - s^ROWS)^BANDS at most, 0.0004 at 0.8. A pair is a
link if its exact probability Jaccard or set Jaccard similarity is at least THRESHOLD.

1. Texts with the same words are copies, found by a 128-bit digest. The least id stands for them from here on, together
   with the digest, as one id may come with several texts.
2. In each band bucket every member is paired with a centre, and the pair is verified. The centre is the member that meets most
   others over all its buckets (ties: the least id): of many copies of one text, that is the text they come from.
3. Links make components by alternating large-star and small-star steps on tables.
4. Members of one centre that are of different components may still be a link. Two such texts share an element that the centre
   lacks, or what they have in common is common with the centre, which the known counts and weights bound. So the centre's members make
   smaller groups: one of those that the bound leaves possible, and one for each element that the centre lacks and that
   a prefix of two members' further elements holds, rarest first (see ``prefixes``). In each group CENTRES members are verified
   against the others that can be a link, components are merged, and the members leave the group; a group of one component is
   closed, and in the rest it goes on with GROWTH times as many, until every group is closed.

So every two texts that share a bucket are in one component, or verified, or proven to be no link: none is lost to a cap, and
pairs inside a component, or of texts that only resemble the same third one, aren't made. The texts' shingles are kept in the
shared folder for that, of candidates only, and are computed once.

Null and empty texts are copies of each other; texts without words are copies if equal but for outer spaces. Every row with an id
gets a result; rows that repeat an id have the same one if their texts are copies, and otherwise each that of its text. Rows
with a null id take no part. Ties go to the least id. Further columns aren't read. Texts may be of any length; one text's
shingles are held in memory at a time with its partner's. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.llm.common import release, stored, tidied

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SLOTS = BANDS * ROWS
#: Tables of keys are broadcast up to this many rows (40 bytes each at most); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
SALTS = 16
#: Members of each open group that a first round verifies against the others, and by how much that grows each round.
CENTRES, GROWTH = 8, 16
#: Two sets of similarity THRESHOLD have at least this share of their sizes' sum in common.
SHARE = THRESHOLD / (1 + THRESHOLD)
KEY = "struct<id: bigint, tag: bigint>"
GROUP = ["a", "within", "e"]
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a sequence of word hashes, ascending, and how often each occurs."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(SHINGLE_WORDS, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = mixed(h * _GAMMA + words[k : n - width + 1 + k])
    return np.unique(h, return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """The element that arrives first in each slot, for each text: (texts, slots). Zeros for a text without elements."""
    first = np.full(texts * slots, np.inf)
    kept = np.zeros(texts * slots, np.uint64)
    e, w, o, t, k = elements, weights.astype(np.float64), owner, np.zeros(len(elements)), 0
    while len(e):
        k += 1
        x = mixed(e + np.uint64(k * int(_GAMMA) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        at = o * slots + (mixed(x ^ _GAMMA) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, at, t)
        hit = first[at] == t
        kept[at[hit]] = e[hit]
        go = t < first.reshape(texts, slots).max(1)[o]
        e, w, o, t = e[go], w[go], o[go], t[go]
    return kept.reshape(texts, slots)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        h = mixed(h * _GAMMA + signature[:, k::ROWS])
    return h.view(np.int64)


def similarities(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Set Jaccard and probability Jaccard of two weighted sets, given by ascending elements and their weights; which of y's elements x has."""
    hit = np.isin(y, x, assume_unique=True)
    common = int(hit.sum())
    jaccard = common / max(1, len(x) + len(y) - common)
    if not common or (nx.max() == 1 and ny.max() == 1):
        return jaccard, jaccard, hit
    wx, wy = nx[np.searchsorted(x, y[hit])].astype(np.float64), ny[hit].astype(np.float64)
    only_x, only_y = float(nx.sum() - wx.sum()), float(ny.sum() - wy.sum())
    order = np.argsort(wy / wx, kind="stable")
    wx, wy = wx[order], wy[order]
    upto = np.searchsorted(wy / wx, wy / wx, side="right")
    low = np.concatenate([[0.0], np.cumsum(wx)])[upto] + only_x
    high = wy.sum() - np.concatenate([[0.0], np.cumsum(wy)])[upto] + only_y
    return jaccard, float((1 / (low / wx + high / wy)).sum()), hit


def probability_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """What the share of equal slots estimates, element by element: for the tests."""
    union = {*a, *b}
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in union) for i in union if i in a and i in b)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, without copying."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets


def _digest(*salt: Column) -> Column:
    """Of a text's words; of the text but for outer spaces, if it has none."""
    return F.xxhash64(*salt, F.col("words"), F.when(F.size("words") > 0, F.lit("")).otherwise(F.col("bare")))


def signed(plain: DataFrame) -> DataFrame:
    """(id, d1, d2, bands): the digest of a text's words and its band hashes, in one pass over the texts."""
    rows = plain.select("id", word_hashes(F.col("text")).alias("words"), F.trim("text").alias("bare"))
    rows = rows.select("id", _digest().alias("d1"), _digest(F.lit("second")).alias("d2"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(3))
            k = 0
            while k < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[k] + 200_000))
                to = min(max(to, k + 1), k + 2048, batch.num_rows)
                sets = [shingles(values[offsets[j] : offsets[j + 1]]) for j in range(k, to)]
                owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
                bands = band_hashes(prob_minhash(np.concatenate([s for s, _ in sets]), np.concatenate([n for _, n in sets]), owner, len(sets)))
                twice = [j for j, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
                flat = [sets[j][0] for j in twice]
                even = dict(zip(twice, band_hashes(prob_minhash(np.concatenate(flat), np.ones(sum(map(len, flat))), np.repeat(np.arange(len(flat)), [len(s) for s in flat]), len(flat))), strict=True)) if flat else {}
                # texts without words have no bands; a band that comes out the same for both weights counts once
                own = [np.union1d(bands[j], even[j]) if j in even else bands[j] if len(s) else bands[j][:0] for j, (s, _) in enumerate(sets)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                part = batch.slice(k, to - k)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], ["id", "d1", "d2", "bands"])
                k = to

    return rows.mapInArrow(tidied(run), "id long, d1 long, d2 long, bands array<bigint>")


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lean(df: DataFrame) -> DataFrame:
    """A stored table as one partition, if it has few rows: what is done with it then needs no shuffle."""
    return df.coalesce(1) if df.count() <= BROADCAST_ROWS else df


def contents(plain: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, elements, weights) of the texts that are asked for: distinct shingle hashes, ascending, as bytes; weights are empty where all are 1."""
    rows = plain.join(small(stored(keys.select("key.id").distinct())), "id", "left_semi").select("id", word_hashes(F.col("text")).alias("words"), F.trim("text").alias("bare"))
    rows = rows.select(F.struct("id", _digest().alias("tag")).alias("key"), "words").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(1))
            for k in range(0, batch.num_rows, 256):
                to = min(k + 256, batch.num_rows)
                sets = [shingles(values[offsets[j] : offsets[j + 1]]) for j in range(k, to)]
                elements = pa.array([s.tobytes() for s, _ in sets], pa.binary())
                weights = pa.array([n.astype(np.uint32).tobytes() if len(n) and n.max() > 1 else b"" for _, n in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, to - k), elements, weights], ["key", "elements", "weights"])

    return rows.mapInArrow(tidied(run), f"key {KEY}, elements binary, weights binary")


def verified(pairs: DataFrame, own: DataFrame, extras: bool = False) -> DataFrame:
    """(a, b, jaccard, probability, size, common, mass, held, extra, weight) of distinct pairs of keys, with the ``contents`` of
    both: exact similarities, b's number of elements and how many of them a has, b's weight and how much of it is on those.

    With ``extras``, ``extra`` and ``weight`` have b's elements that a lacks, and their weights.
    """
    pairs = small(pairs)
    name = lambda side: [F.col("key").alias(side), F.col("elements").alias(f"e{side}"), F.col("weights").alias(f"w{side}")]
    asked = own.join(pairs.select(F.col("a").alias("key")), "key", "left_semi").select(*name("a"))
    rows = own.select(*name("b")).join(pairs, "b").join(asked, "a").select("a", "b", "ea", "wa", "eb", "wb")
    kinds = {"jaccard": pa.float64(), "probability": pa.float64(), "size": pa.int64(), "common": pa.int64(), "mass": pa.int64(), "held": pa.int64(), "extra": pa.list_(pa.int64()), "weight": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weighted(e: pa.Scalar, w: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            e, w = np.frombuffer(e.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.uint32)
            return e, w.astype(np.int64) if len(w) else np.ones(len(e), np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                for ea, wa, eb, wb in zip(*part.columns[2:], strict=True):
                    (x, nx), (y, ny) = weighted(ea, wa), weighted(eb, wb)
                    jaccard, probability, hit = similarities(x, nx, y, ny)
                    more = (y[~hit].view(np.int64), ny[~hit]) if extras else ([], [])
                    found.append((jaccard, probability, len(y), int(hit.sum()), int(ny.sum()), int(ny[hit].sum()), *more))
                columns = [pa.array([row[k] for row in found], t) for k, t in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["a", "b", *kinds])

    return rows.mapInArrow(tidied(run), f"a {KEY}, b {KEY}, jaccard double, probability double, size long, common long, mass long, held long, extra array<bigint>, weight array<bigint>")


def near() -> Column:
    return (F.col("jaccard") >= THRESHOLD) | (F.col("probability") >= THRESHOLD)


def with_root(df: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with the root of column ``of``; a key that ``roots`` lacks is its own."""
    known = roots.select(F.col("id").alias(of), F.col("root").alias(name))
    return df.join(known, of, "left").withColumn(name, F.coalesce(name, of))


def possible(x: str, y: str, within: Column) -> Column:
    """Whether two members of a group can be a link, from what each has in common with the centre and, unless they are to meet by the
    centre's elements alone (``within``), from the group's element on.

    They share at most the lesser ``common`` of the centre's elements and the lesser ``after`` of others. Two sets have SHARE of their sizes
    in common at least. By weight: if x has the share p of its weight on elements of y, and y the share q on elements of x, the
    similarity is at most 1 / (1 / p + 1 / q - 1). Where no element repeats in either text both similarities are the same, and
    the counts are enough.
    """
    of = lambda side, c: F.col(f"{side}.{c}")
    least = F.least(of(x, "common"), of(y, "common"))
    more = F.when(within, 0).otherwise(F.least(of(x, "after"), of(y, "after")))
    counts = least + more >= SHARE * (of(x, "size") + of(y, "size")) - 1e-9
    p, q = ((of(side, "held") + F.when(within, 0).otherwise(of(side, "mass_after"))) / of(side, "mass") for side in (x, y))
    repeats = (of(x, "mass") > of(x, "size")) | (of(y, "mass") > of(y, "size"))
    return counts | (repeats & (1 / p + 1 / q <= 1 + 1 / THRESHOLD + 1e-9))


def prefixes(own: DataFrame) -> DataFrame:
    """(a, within, e, b, size, common, mass, held, after, mass_after): the elements e by which members of a centre can meet that share some
    which the centre lacks; how many such elements of b come from e on, and what they weigh.

    Such elements of a member are put in order, the rarest among the centre's members first. A link of sets x and y has at least
    THRESHOLD * |x| elements in common, of which the centre can give ``common``; by weight, the same holds of x's weight and
    ``held``. The first shared element is followed, itself included, by all the other shared ones, so only elements that so many
    (or so much weight) follow have to be looked at. Those that no other member has come first and are left out. Two members
    need to meet by the first element only that they share, so of elements with the same members the first one is enough.
    """
    lines = own.select("a", "b", "size", "common", "mass", "held", F.explode(F.arrays_zip("extra", "weight")).alias("x")).select("*", F.col("x.extra").alias("e"), F.col("x.weight").alias("w")).drop("x")
    often = stored(lines.groupBy("a", "e").agg(F.count("*").alias("n")).where("n > 1"))
    after = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.join(small(often), ["a", "e"]).select("*", F.count("*").over(after).alias("after"), F.sum("w").over(after).alias("mass_after"))
    enough = (F.col("after") >= THRESHOLD * F.col("size") - F.col("common") - 1e-9) | (F.col("mass_after") >= THRESHOLD * F.col("mass") - F.col("held") - 1e-9)
    lines = stored(lines.where(enough))
    same = [F.count("*").alias("members"), F.bit_xor(F.xxhash64("b")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "b")).alias("h2")]
    first = lines.groupBy("a", "e").agg(F.min("n").alias("n"), *same).where("members > 1").groupBy("a", "members", "h1", "h2").agg(F.min(F.struct("n", "e")).alias("first"))
    lines = lines.join(small(stored(first.select("a", F.col("first.e").alias("e")))), ["a", "e"], "left_semi")
    return lines.select("a", F.lit(False).alias("within"), "e", "b", "size", "common", "mass", "held", "after", "mass_after")


def groups_of(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, within, e, b, size, common, mass, held, after, mass_after): the groups of step 4, for centres with members of several components."""
    known = small(roots)
    own = with_root(with_root(stars.select("a", "b"), known, "b", "root_b"), known, "a", "root_a")
    torn = stored(own.where("root_a <> root_b").select("a").distinct())
    own = stored(stars.join(small(torn), "a", "left_semi").drop("jaccard", "probability"))
    facts = own.drop("extra", "weight")
    # whom a member can link to by the centre's elements alone: neither too large nor too small, or of enough weight there
    part, repeats, largest = F.col("held") / F.col("mass"), F.col("mass") > F.col("size"), F.col("common") / SHARE - F.col("size")
    limits = facts.groupBy("a").agg(F.min("size").alias("least"), F.max(largest).alias("most"), F.max(part).alias("top"), F.max(F.when(repeats, part)).alias("top_repeats"))
    sets = (F.col("least") <= largest + 1e-6) & (F.col("size") <= F.col("most") + 1e-6)
    partner = F.when(repeats, F.col("top")).otherwise(F.col("top_repeats"))
    weights = F.coalesce(1 / part + 1 / partner <= 1 + 1 / THRESHOLD + 1e-9, F.lit(False))
    by_centre = facts.join(small(stored(limits)), "a").where(sets | weights).select("a", F.lit(True).alias("within"), F.lit(0).cast("long").alias("e"), "b", "size", "common", "mass", "held", *[F.lit(0).cast("long").alias(c) for c in ("after", "mass_after")])
    return prefixes(own).unionByName(by_centre)


def closed(groups: DataFrame, roots: DataFrame, own: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(links, roots) once every two members of a group are of one component, or verified, or no link."""
    found, centres, groups, roots = None, CENTRES, lean(stored(groups)), lean(roots)
    while True:
        live = with_root(groups, roots, "b", "root")
        torn = live.groupBy(*GROUP).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*GROUP)
        live = lean(stored(live.join(torn, GROUP, "left_semi")))
        if live.isEmpty():
            return found, roots
        order = Window.partitionBy(*GROUP).orderBy(F.desc(F.col("held") / F.col("mass")), F.desc("size"), "b")
        chosen = live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= centres).drop("place")
        both = chosen.alias("x").join(live.alias("y"), GROUP).where((F.col("x.root") != F.col("y.root")) & possible("x", "y", F.col("within")))
        pairs = stored(both.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct())
        if not pairs.isEmpty():
            links = lean(stored(verified(pairs, own).where(near()).select("a", "b")))
            found = links if found is None else found.unionByName(links)
            between = with_root(with_root(links, roots, "a", "root_a"), roots, "b", "root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            up = lean(components(between))
            moved = up.select(F.col("id").alias("root"), F.col("root").alias("to"))
            roots = lean(stored(roots.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")).unionByName(up)))
        groups = live.drop("root").join(chosen.select(*GROUP, "b"), [*GROUP, "b"], "left_anti")
        centres *= GROWTH


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least key of each linked key's component, for every key that isn't itself the least."""
    edges = lean(stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()))
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    together = (lambda df: df.coalesce(1)) if before[0] <= BROADCAST_ROWS else (lambda df: df)
    while before[0]:
        both = together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lesser = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = together(stored(together(lesser.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): for each bucket, its centre and every other member."""
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stored(members.join(small(crowded), "bucket"))
    mates = shared.groupBy("rep").agg(F.sum("n").alias("mates"))
    top = F.min(F.struct((-F.col("mates")).alias("minus"), "rep"))
    centres = stored(shared.join(mates, "rep").groupBy("bucket").agg(top.alias("top")).select("bucket", F.col("top.rep").alias("a")))
    pairs = stored(shared.join(small(centres), "bucket").where("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    release(crowded, shared, centres)
    return pairs


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, rep, root, verified_links) of every row with an id: the key of its text, of the least copy, of the group."""
    plain = _plain(docs, id_col, text_col)
    rows = stored(signed(plain))
    classes = rows.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = classes.withColumn("rep", F.struct(F.col("least").alias("id"), F.col("d1").alias("tag")))
    pairs = candidates(classes)
    own = stored(contents(plain, pairs.select(F.explode(F.array("a", "b")).alias("key"))))
    stars = stored(verified(pairs, own, extras=True))
    links = stars.where(near()).select("a", "b")
    roots = lean(components(links))
    more, roots = closed(groups_of(stars, roots), roots, own)
    links = links if more is None else links.unionByName(more).distinct()
    degree = stored(links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("verified_links")))
    release(pairs, own, stars)
    # only texts with copies need a look-up; a salt deals out the rows of a text that has very many
    several = classes.where("copies > 1").select("d1", "d2", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = rows.select("id", "d1", "d2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = named.join(several, ["d1", "d2", "salt"], "left").select("id", F.col("d1").alias("tag"), F.coalesce("rep", F.struct("id", F.col("d1").alias("tag"))).alias("rep"))
    named = with_root(named, small(roots), "rep", "root").join(small(degree), "rep", "left")
    return named.select("id", "tag", "rep", "root", F.coalesce("verified_links", F.lit(0)).alias("verified_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy_of, class_id, class_text, verified_links) of every row with an id: the least id with the same words; the least id of the
    group; a hash of that one's words, which parts groups of different texts under one id; and how many of the words' links were
    verified: those with centres, and what step 4 adds. Pairs inside a component aren't counted."""
    found = classified(docs, id_col, text_col)
    return found.select("id", F.col("rep.id").alias("copy_of"), F.col("root.id").alias("class_id"), F.col("root.tag").alias("class_text"), "verified_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that another one of their group, the one with the least id, stands for. A null id stays.

    Of rows with the same id and words the one stays whose columns have the least hash. Ids with one row are dealt
    with by id alone; only those with several are told apart by their words.
    """
    found = stored(classified(docs, id_col, text_col).select("id", "tag", (F.struct("id", "tag") == F.col("root")).alias("stays")))
    ids = found.groupBy("id").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    single = stored(ids.where("n = 1 and not stays").select("id"))
    several = stored(ids.where("n > 1").select("id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    if several.isEmpty():
        return rows.join(small(single), "id", "left_anti").select("row.*")
    gone = small(stored(single.unionByName(several)))
    texts = rows.join(small(several), "id", "left_semi").withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    texts = texts.select("id", "row", word_hashes(F.col("text")).alias("words"), F.trim("text").alias("bare")).select("id", "row", _digest().alias("tag"))
    stays = stored(found.where("stays").select("id", "tag").join(small(several), "id", "left_semi").distinct())
    texts = texts.join(small(stays), ["id", "tag"], "left_semi")
    first = Window.partitionBy("id", "tag").orderBy(F.xxhash64("row"))
    texts = texts.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.join(gone, "id", "left_anti").select("row.*").unionByName(texts.select("row.*"))
