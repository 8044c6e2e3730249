"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.llm import bpe, chat, fingerprints, language, line_dedup, near_dup, packing, quality, topk, toxicity
from treadle.llm.common import in_fold, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.select("*", fingerprints.sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        fingerprints.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, i AS line, lower(trim(x, ' ')) AS x, x AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), w AS (
  SELECT doc_id, line, x, lead(x, 1) OVER d AS y, lead(x, 2) OVER d AS z FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY line)
), later AS (
  SELECT doc_id, line FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, line) AS r
    FROM w WHERE z IS NOT NULL AND (x <> '' OR y <> '' OR z <> ''))
  WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, line + k AS line FROM later, (VALUES (0), (1), (2)) AS s(k)
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line) AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line
  WHERE g.line IS NULL GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), r AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v AS query, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: in_fold(F.col(c), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id") & F.col("doc_id").isNotNull())
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: in_fold(F.col(c), 3, 1)
    net = language.fit(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    return language.predict(docs, net).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_messages(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH m AS (
  SELECT row_number() OVER () AS uid, conv_id, turn, coalesce(role, 'unknown') AS role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), l AS (
  SELECT uid, conv_id, turn, i, x, regexp_extract(x, '^([ \t]*>)+') AS mark
  FROM (SELECT uid, conv_id, turn, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM m)
), n AS (
  SELECT uid, conv_id, turn, i, x, length(mark) - length(replace(mark, '>', '')) AS raw_level,
    lower(trim(regexp_replace(substr(x, length(mark) + 1), '\s+', ' ', 'g'))) AS norm FROM l
), n2 AS (
  SELECT *, length(regexp_extract(x, '^([ \t]*>)+')) - length(replace(regexp_extract(x, '^([ \t]*>)+'), '>', '')) AS lv FROM n
), k AS (
  SELECT uid, conv_id, turn, i, x, norm, CASE WHEN lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY uid ORDER BY i), 0) > 0
    AND regexp_matches(x, '(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$') THEN -1 ELSE lv END AS level FROM n2
), k2 AS (
  SELECT *, CASE WHEN coalesce(lag(norm) OVER w, '') <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS starts FROM k WINDOW w AS (PARTITION BY uid ORDER BY i)
), p AS (SELECT *, sum(starts) OVER (PARTITION BY uid ORDER BY i) AS passage FROM k2
), p2 AS (SELECT * FROM p WHERE norm <> '' AND level >= 0
), u AS (
  SELECT DISTINCT conv_id, turn, level, norm FROM (
    SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) AS norm FROM p2 GROUP BY uid, conv_id, turn, level, passage
    UNION ALL SELECT conv_id, turn, level, norm FROM p2) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), q AS (
  SELECT a.conv_id, a.turn, a.level, a.norm, max(b.turn) AS original FROM u a JOIN u b
  ON a.conv_id = b.conv_id AND a.norm = b.norm AND a.level > 0 AND b.level = 0 AND b.turn < a.turn GROUP BY ALL
), s AS (SELECT conv_id, turn, level, original, sum(length(norm)) AS chars FROM q GROUP BY ALL
), best AS (
  SELECT conv_id, turn, original AS linked FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, original DESC) AS r FROM s) WHERE r = 1
), t AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), t2 AS (
  SELECT t.conv_id, t.turn, coalesce(linked, previous) AS reply_to, linked IS NOT NULL AS linked,
    max(CASE WHEN previous IS NULL OR linked <> previous THEN t.turn END) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS branch
  FROM t LEFT JOIN best ON t.conv_id = best.conv_id AND t.turn = best.turn
), body AS (
  SELECT uid, regexp_replace(trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (level = 0), '')), '^\n+|\n+$', '', 'g') AS content, greatest(0, max(level))::INTEGER AS quote_depth FROM k GROUP BY uid
)
SELECT m.conv_id, m.turn, m.role, body.content, body.quote_depth, t2.reply_to, coalesce(t2.linked, false) AS linked, t2.branch,
  CASE WHEN t2.branch IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id, t2.branch ORDER BY m.turn, m.role, body.content) - 1 END AS position,
  '<|' || m.role || '|>' || chr(10) || body.content || chr(10) || '<|end|>' AS formatted
FROM m JOIN body USING (uid) LEFT JOIN t2 ON m.conv_id = t2.conv_id AND m.turn = t2.turn
"""


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "copy_of", "class_id", "class_text", "verified_links")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: in_fold(F.col(c), 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id") & F.col("doc_id").isNotNull())
    graded = quality.grade(docs, model)
    return graded.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= 0.5).alias("selected"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_line_dedup, op3_toxicity, op4_packing, op5_language, op6_chat, op7_bpe, op8_near_dup, op9_topk, op10_quality)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op6_chat": OP6_SQL, "op9_topk": OP9_SQL}
