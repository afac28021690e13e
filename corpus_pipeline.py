"""The corpus pipeline: each stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import mixing, near_dedup, packing, quality, repeats
from anchorage.llm.common import discard, staged, table
from anchorage.llm.tokens import public_path

ORACLE_SQL = None


def kept_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with all their columns, their texts without the lines above the limit.

    Repeated rows are judged alike and all kept or all rejected; null and empty texts are
    rejected; columns of any name come through, and an empty table gives no rows.
    """
    return quality.kept_documents(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Of rows that repeat id and text one stays; so does one row of copies without any id.
    """
    kept = near_dedup.near_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    held = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    same = held["doc_id"].eqNullSafe(kept["_id"]) & (held["text_hash"] == kept["_text"])
    return held.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages that occur more than once; n_chars follows the text.

    A text that repeats as a whole becomes empty; a null text is empty afterwards.
    """
    return repeats.cut_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, written in the order in which the schedule interleaves the sources.

    Rows without a source are a source of their own and repeated rows come as often as they
    were; columns of any name come through, and an empty table gives no rows.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of every document within windows of the mix; null texts count as empty.

    The documents are taken in the order in which the mix was written, so that sequences
    hold and follow it. Repeated rows are packed each, other columns are left out, and an
    empty table gives no rows.
    """
    return packing.pack_in_order(docs, public_path())


STAGES = [
    ("quality rules", kept_by_quality),
    ("near-dedup", one_per_group),
    ("suffix-array dedup", without_repeated_passages),
    ("mixing to target weights", mixed_sources),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the table ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for k, (name, stage) in enumerate(first):
        kept = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(docs)
        docs = kept
    return last(spark, docs, sf_dir)
