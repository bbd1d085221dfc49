"""A corpus from raw documents to token ids, in five stages over the operators of tidemark.llm.

Each stage works on all rows that its predecessor kept, and is written as Parquet before the next one reads it.
All stages but the last return the columns of documents. Empty tables give empty results; columns beyond those
of documents go through as they are, whatever their names. Shuffle files go as soon as the query that made them has
ended, so that the stages' disk doesn't add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, pieces, simhash, units
from tidemark.llm.common import TIDY, dropped, tables_of, written
from tidemark.sources import read_table, ship

#: Documents whose language takes less than this share of their n-grams are rejected.
LEAST_SCORE = 0.5


def _tidy(spark: SparkSession) -> None:
    """A stage's result is written by its caller, so the setting has to hold when the stage is left; run() sets it back."""
    spark.conf.set(TIDY, "true")


def _packed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that a stage reads, and all others in one struct, so that no name of theirs matters."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in read]
    return docs.select(*read, F.struct(F.lit(True).alias("_"), *others).alias("others"))


def _unpacked(found: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    """The columns of docs from rows that _packed made, those read as they are now."""
    return found.select(*(F.col(c) if c in read else F.col("others")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; the model learns from the labelled ones among them.

    Null and letterless texts go. Columns of docs stay as they are.
    """
    _tidy(spark)
    found = langid.identify(_packed(docs, "text"), langid.train(docs.select("text", "lang")))
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)), docs, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays; documents without an id stay.
    """
    _tidy(spark)
    return simhash.keep_one(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages (runs of sentences of 30 words or more) that an earlier document, or an earlier
    place, has already.

    n_chars follows the text. Documents of which nothing is left go; others stay, also those that had no
    text before.
    """
    _tidy(spark)
    found, text = units.remove_repeats(_packed(docs, "doc_id", "text", "n_chars")), F.col("text")
    left = found.where((F.col("n_removed") == 0) | (F.trim(F.translate(text, "\n", " ")) != ""))
    return _unpacked(left.withColumn("n_chars", F.length(text).cast("long")), docs, "doc_id", "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources without words give nothing."""
    _tidy(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each row's whole text, with its n best segmentations."""
    _tidy(spark)
    return pieces.encode(docs, n=4)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can't express the language model, SimHash or the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents."""
    docs, before = read_table(ship(spark), sf_dir, "documents"), spark.conf.get(TIDY, "false")
    try:
        for name, stage in STAGES:
            with tables_of(spark) as made:
                last, docs = docs, written(stage(spark, docs, sf_dir), name)
            dropped(last, *(t for t in made if t is not docs))
    finally:
        spark.conf.set(TIDY, before)
    return docs
