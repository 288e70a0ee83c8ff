"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.leak import find_leaks
from lodestone.llm.lookalike import find_lookalikes, unify
from lodestone.llm.mixture import draw_mix
from lodestone.llm.neardup import duplicate_classes, near_duplicate_pairs
from lodestone.llm.pii import find_personal_data, redact
from lodestone.llm.sentences import find_sentences
from lodestone.llm.treesplit import split_oversized
from lodestone.sources.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_item_reach(spark: SparkSession, folder: str) -> DataFrame:
    """For every evaluation item, in how many documents it leaked."""
    items = table(spark, folder, "eval_items").select("item_id", "suite", "lang")
    hits = p6_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", "lang", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bench queries and the chunks that show but don't store them."""
    bench = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"), "query")
    return find_lookalikes(table(spark, folder, "chunks"), bench)


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its text in the one consistent form, and whether that differs."""
    chunks = unify(table(spark, folder, "chunks").select("chunk_id", "text"))
    return chunks.select("chunk_id", "unified", (~F.col("text").eqNullSafe(F.col("unified"))).alias("changed"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return split_oversized(table(spark, folder, "chunks"), blank=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that had to be split."""
    return p4_pieces(spark, folder).select("chunk_id").distinct()


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the largest mix that meets the target shares, with their uses."""
    return draw_mix(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in that mix."""
    return draw_mix(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[1]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of personal information in the chunks, by its place."""
    return find_personal_data(table(spark, folder, "chunks")).drop("entity")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks with surrogates in the place of personal information."""
    return redact(table(spark, folder, "chunks").select("chunk_id", "text"), secret="not-a-secret").select("chunk_id", "redacted")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that repeat one another with small changes."""
    return near_duplicate_pairs(table(spark, folder, "chunks"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document."""
    return find_sentences(table(spark, folder, "documents"), lang="lang").drop("sentence")


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its class of equal texts and the number of similar classes."""
    return duplicate_classes(table(spark, folder, "chunks"))


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_unified": p3_unified,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_item_reach": p6_item_reach,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
}
ORACLES: dict[str, str] = {"p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 900"}
