"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from . import fim, imatch, langid, licenses, merkle, mixing, ngrams, pieces, pivots, revisits, simhash, units


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, similarity=None, words=1, radius=2)
    return found.select("doc_id", simhash.fp_hex(found.fp).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_units", "n_removed", F.array_join(spans, ",").alias("removed"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(read_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(read_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.crc_thirds("doc_id") == 1)
    model = langid.train(docs.where("NOT held_out"))
    found = langid.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, digest=True)
    return found.select(
        "doc_id", "n_pieces", "ids_sha256", "score", F.transform("n_best", lambda b: b["score"]).alias("scores"),
        F.transform("n_best", lambda b: b["pieces"]).alias("n_best_pieces"), F.to_json("n_best.changes").alias("changes"), "round_trip",
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read_table(spark, sf_dir, "documents"), carried=["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read_table(spark, sf_dir, "documents")).drop("sides", "siblings")


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.transform(read_table(spark, sf_dir, "documents"), seed=1))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_imatch, op2_simhash_near_dedup, op3_substring_dedup, op4_token_counts, op5_warc_revisits,
        op6_language_id, op7_pivot_top_k, op8_sentencepiece, op9_mix_sources, op10_license_scan,
        op11_merkle_manifest, op12_ngram_jaccard_join, op13_fill_in_middle,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": units.ORACLE,
        "op5_warc_revisits": revisits.ORACLE,
        "op7_pivot_top_k": pivots.ORACLE,
        "op9_mix_sources": mixing.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op13_fill_in_middle": fim.ORACLE,
    }
