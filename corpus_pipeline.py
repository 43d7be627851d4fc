"""A corpus pipeline of five operators, each stage over all that the one before has kept.

Between stages a table is written to the shared folder, so that a lost executor costs one stage at most.
Stages keep the columns of documents; where a text changes, n_chars follows it. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm import jaccard, line_dedup, packing, substring_dedup
from odweave.llm import toxicity as toxic
from odweave.llm.bpe import vocabulary
from odweave.llm.common import arrow_ready, discard, table, written

#: Score from which a document is rejected.
REJECT = 0.5

#: A trained classifier and tokenizers stand in the way of SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as its texts now are."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of this corpus doesn't score as toxic; null and empty texts stay or go by the intercept."""
    arrow_ready(spark)
    model = toxic.train(docs, table(spark, sf_dir, "labels"))
    own = docs.withColumnRenamed("score", "_own_score") if "score" in docs.columns else docs
    kept = toxic.score(own, model).filter(F.col("score") < REJECT).drop("score")
    return kept.withColumnRenamed("_own_score", "score").select(*docs.columns)


def line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return _counted(line_dedup.line_dedup(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id; a null id is larger than any.

    Rows that repeat an id with the same text are one document, of which the row with the smallest hash stays; with
    other texts they are documents of their own. Texts without words are similar to nothing, and all stay.
    """
    arrow_ready(spark)
    said = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = jaccard.representatives(docs.select("doc_id", "text")).withColumnRenamed("id", "_id")
    marked = docs.filter(said).withColumn("_mark", F.xxhash64("text"))
    kept = marked.join(stay, marked["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (marked["_mark"] == stay["mark"]), "left_semi")
    order = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    once = kept.groupBy(F.col("doc_id").alias("_id"), "_mark").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return once.select("_row.*").unionByName(docs.filter(~said))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words that stand anywhere else, nor parts of characters."""
    arrow_ready(spark)
    cut = substring_dedup.remove_repeats(docs, length=substring_dedup.PASSAGE, words=substring_dedup.PASSAGE_WORDS, rewrite=True)
    return _counted(cut, docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents, packed into windows."""
    arrow_ready(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_removal),
    ("jaccard_join", near_copies),
    ("suffix_array_dedup", repeats),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
