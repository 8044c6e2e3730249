"""A training corpus from `documents`: toxicity, language, repeated lines, near-duplicates, packing.

Null and empty texts have no letter, so the language stage drops them, unless there is no language to learn from; then every document
passes it. Rows that repeat an id are documents of their own until the near-duplicate stage, which keeps one of those with the same words.
Rows with a null id pass all stages. Ties go to the least id. Very long texts are read whole by every stage. Columns besides doc_id,
text, lang, source and n_chars are carried along, whatever their names, to the last stage, which returns pieces. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadle.llm import language, line_dedup, near_dup, packing, toxicity
from treadle.llm.common import stored, table
from treadle.llm.queries import vocabulary

#: A document goes if its toxicity is at least this, or its language's probability below that.
TOXIC = 0.5
KNOWN = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels; documents that score as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull())
    return toxicity.keep_clean(docs, model, TOXIC)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' languages; documents without a letter go, and those whose language is more likely mistaken than not."""
    return language.keep_known(docs, language.fit(docs, F.lit(True)), KNOWN)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias(""), *others).alias("row")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    return near_dup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("line_dedup", line_stage), ("near_dup", near_dup_stage), ("packing", packing_stage)]

#: The stages' models and the tokenizer can't be written as SQL; the tests hold the stages' decisions against plain Python ones, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
