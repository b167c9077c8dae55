"""The queries opN_<name> of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, divergence, langid, licenses, lm, mixing, neighbours, pii, repeats, simhash, sketch, warc
from ._spark import new_path, table
from .oracles import ORACLES  # noqa: F401

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _crc(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "pieces", "shards")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc("doc_id") % 3 == 1, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    out = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontaminate.find_passages(docs.select("doc_id", "text"), items, keep=["doc_id"])
    return (
        out.withColumn("n_hit", F.expr(decontaminate.N_HIT))
        .select(
            "doc_id",
            F.col("_n_words").alias("n_words"),
            "n_hit",
            F.size("_items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            F.expr("n_hit > 0 AND 20 * n_hit >= _n_words").alias("contaminated"),
        )
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_crc("doc_id") % 5 == 1, F.lit(False))
    out = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [F.col("_counts")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.col("_base_sha256").alias("base_sha256"), F.col("_all").alias("spans"))


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return alignment.compare(table(spark, sf_dir, "documents"), f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_fingerprints": op4_fingerprints,
    "op5_licenses": op5_licenses,
    "op6_lm_score": op6_lm_score,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_remove_repeats": op9_remove_repeats,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

