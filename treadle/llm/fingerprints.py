"""Bottom-k sketches of word shingles, in DataFrame functions only.

A text's words are its runs of letters, marks and digits, in lower case; a shingle is five words in a row (all words, if they are
fewer). A sketch holds the k smallest distinct 48-bit shingle hashes, in order. The sketch of a union of texts is the
k smallest of their sketches' hashes, so sketches merge across parts. Resemblance is the share of the k smallest
hashes of the union that both sketches hold; it is exact while both have fewer than k. Containment is the share of
the hashes of one sketch, up to the other's largest where that is full, that the other holds. The distinct count
follows from the k-th smallest hash.

A null or empty text, or one without words, has an empty sketch; two empty sketches are alike (1), an empty and
another one not (0). Repeated shingles count once, and equal texts have equal sketches. Texts may be of any length:
a text is handled in its own row. A text follows another by ascending id, ties by text; a null id has no neighbours,
so its next text counts as empty. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.llm.common import let

K = 256
HASH_BITS = 48
SHINGLE_WORDS = 5
#: Rows of a group of neighbouring ids, about; groups at most, whose least ids are broadcast; and how many of their limits are compared at once.
SPAN = 1024
GROUPS = 4096
STEP = 64


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The hashes of all shingles of a text, in order, repeated ones included."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
    of = lambda a, k: cut(F.xxhash64(*[F.get(a, k + j) for j in range(words)]))
    return let(
        F.transform(found, lambda w: F.xxhash64(w)),
        lambda a: F.when(F.size(a) >= words, F.transform(F.sequence(F.lit(0), F.size(a) - words), lambda k: of(a, k))).when(F.size(a) > 0, F.array(cut(F.xxhash64(a)))).otherwise(F.array().cast("array<bigint>")),
    )


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    seen = F.when(F.size(b) < k, a).otherwise(F.filter(a, lambda h: h <= F.element_at(b, -1)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(let(seen, lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s, b)) / F.size(s))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / F.element_at(a, -1))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def merged_sketches(sketches: DataFrame, by: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of parts. Hashes are counted once before and after the shuffle; a group's k smallest are found in parts, then of those."""
    rows = sketches.select(*by, F.explode(col).alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    low = Window.partitionBy(*by, "part").orderBy("h")
    rows = rows.withColumn("r", F.row_number().over(low)).where(F.col("r") <= k)
    least = Window.partitionBy(*by).orderBy("h")
    rows = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k)
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(col))


def _limits(ids: DataFrame) -> list[int]:
    """Ids that part the rows into groups of about equal size, however the ids are spread; from approximate percentiles."""
    groups = min(GROUPS, -(-ids.count() // SPAN))
    if groups < 2:
        return []
    places = [k / groups for k in range(1, groups)]
    found = ids.agg(F.percentile_approx("id", places, 10 * GROUPS).alias("x")).first()["x"]
    return sorted(set(found))


def _group(limits: list[int]) -> Column:
    """How many limits an id reaches, in two steps of comparisons."""
    if not limits:
        return F.lit(0)
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    reached = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("id")))
    if len(limits) <= STEP:
        return reached(listed(limits))
    coarse = reached(listed(limits[STEP - 1 :: STEP]))
    return let(coarse, lambda c: c * STEP + reached(F.slice(listed(limits), c * STEP + 1, STEP)))


def _heads(ids: DataFrame, group: Column) -> DataFrame:
    """(head, before): the least id of each of the GROUPS groups at most, and the group that comes before, the last group for the first."""
    groups = ids.groupBy(group.alias("g")).agg(F.min("id").alias("head"))
    whole = Window.partitionBy(F.lit(0))
    return groups.select("head", F.coalesce(F.lag("g").over(whole.orderBy("g")), F.max("g").over(whole)).alias("before"))


def with_next(docs: DataFrame, carried: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sketch, next_text, next_sketch), one shuffle of the texts by group of ids; ``carried`` is the sketch of column text.

    The first document of each group also travels, as a guest, to the group before, where it follows the last one. The rows of one id
    are put in order together; they spill.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.where("id is not null").select("id")
    group = _group(_limits(ids))
    heads = F.broadcast(_heads(ids, group))
    rows = rows.join(heads, rows["id"] == heads["head"], "left")
    rows = rows.withColumn("own", F.when(F.col("id").isNotNull(), group).otherwise(-1 - F.abs(F.xxhash64("text") % SPAN)).cast("long"))
    places = F.when(F.col("head").isNull(), F.array(F.struct(F.col("own").alias("g"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("g"), F.lit(0).alias("guest")), F.struct(F.col("before").cast("long").alias("g"), F.lit(1).alias("guest"))))
    rows = rows.select("id", "text", F.explode(places).alias("p")).select("id", "text", F.col("p.g").alias("g"), F.col("p.guest").alias("guest"), F.col("id").isNull().alias("apart"))
    rows = rows.repartition("g", "apart").withColumn("sketch", sketch(F.col("text")) if carried is None else carried)
    order = Window.partitionBy("g", "apart").orderBy("guest", "id", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    alone = lambda c, empty: F.when(F.col("apart"), empty).otherwise(F.col(c)).alias(c)
    return rows.where("guest = 0").select("id", "text", "sketch", alone("next_text", F.lit("")), alone("next_sketch", F.array().cast("array<bigint>")))
