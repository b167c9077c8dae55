"""A corpus pipeline: each stage takes the documents that the one before kept, and hands on Parquet.

Language ID drops documents without a language, SimHash keeps one document of each group of near copies, decontamination drops
those that hold benchmark passages, personal data is masked, and sources are mixed to target weights.

In every stage null texts count as empty, an empty table gives an empty result, rows of equal ids are rows of their own, columns of any name are kept, and
whole texts are read, however long they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm import decontaminate, langid, mixing, pii, simhash
from resight.llm._spark import new_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are null, have no letter, or of whose n-grams no language has a tenth; repeated rows share their fate."""
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each group of near copies; of equal ids one row."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with one word in twenty or more inside a benchmark window; without benchmark items none."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows; null texts stay null."""
    hidden = pii.mask_text(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else hidden


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their texts, how many words of each the mix takes, and which ones go to which shard and place in it.

    mixing.written_mix() writes the shuffled shards from this; with a third copy of the texts, the disk of this stage would pass its limit.
    """
    return mixing.with_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pii", without_pii),
    ("mix_sources", mixed_sources),
]

#: SQL can't express the model, the links and the tree: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
