"""A corpus from raw documents to packed sequences: STAGES in order, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, ngram_join, packing, pii
from tidemark.llm.common import forget, held_out, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without a letter have none and go.

    Profiles are learned from the documents outside the held-out fold, as in the query for language identification.
    """
    model = langid.learn(docs.where(~held_out()))
    labelled = langid.identify(docs.select("doc_id", "source", "text"), model, with_text=True)
    kept = labelled.where(F.col("lang_pred") != langid.UNKNOWN)
    return _with_length(kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source"))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least id stays.

    Of rows with the same id, the one stays whose text the join took for it; of those with that text, the first by lang, source
    and n_chars, nulls first. Rows without an id go, as nothing later could tell them apart.
    """
    kept = ngram_join.join(docs, with_mark=True).where("kept").select("doc_id", "mark")
    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.join(kept, "doc_id").where(own == F.col("mark"))
    first = Window.partitionBy("doc_id").orderBy("lang", "source", "n_chars", F.col("text").isNull())
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets; every document stays."""
    return _with_length(pii.masked(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: dict[str, float] = mixing.TARGETS) -> DataFrame:
    """Each document appears as often as its rate says; the good domain keeps its size, the others are cut to their share.

    A rate is rounded up or down by the id's hash, and the fit bounds that of a document more likely good than not by one from below.
    """
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), targets, keep_first=True, keep=COLUMNS)
    many = rated.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, each with the checksum of its ids."""
    return packing.harmonic_pack(packing.tokenized_pieces(docs, packing.default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near duplicates", join_ngrams),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express no stage, so there is none; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs from all documents. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            forget(before)
        before = docs
    return docs
