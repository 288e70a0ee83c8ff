"""Fusion, guardrails, de-duplication, explanation and assembly of search results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import SPACE, citation, query_tokens, round_half_up, trim_space


def normalised(queries: DataFrame, top_k: int = 5, min_score: float = 0.0, drop_empty: bool = False) -> DataFrame:
    """``query_id, query, k, min_score``: trimmed questions with their limits.

    Columns ``k`` and ``min_score`` of ``queries`` override the defaults where they
    aren't null; other columns are left aside.  A null, empty or blank question is an
    error when the rows are read, or with ``drop_empty`` left out.
    """
    text = trim_space(F.coalesce("query", F.lit("")))
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in queries.columns else F.lit(default)
    rows = queries.where(F.length(text) > 0) if drop_empty else queries
    wording = text if drop_empty else F.when(F.length(text) > 0, text).otherwise(F.raise_error(F.concat(F.lit("the text of a query is empty: "), F.coalesce(F.col("query_id").cast("string"), F.lit("?")))))
    return rows.select("query_id", wording.alias("query"), own("k", top_k).cast("int").alias("k"), own("min_score", float(min_score)).cast("double").alias("min_score"))


def fuse(semantic: DataFrame, lexical: DataFrame, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, key, semantic_rank, lexical_rank, score``."""
    s = semantic.select("query_id", key, F.col("rank").alias("semantic_rank"))
    x = lexical.select("query_id", key, F.col("rank").alias("lexical_rank"))
    both = s.join(x, ["query_id", key], "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("semantic_rank") + part("lexical_rank"))


def _order() -> list[Column]:
    return [F.round("score", 12).desc(), F.col("semantic_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last()]


@dataclass(frozen=True)
class Policy:
    """What a result must fulfil; ``None`` switches a test off (of ``min_score``: takes the hits' own column)."""

    statuses: tuple[str, ...] = ("active",)
    types: tuple[str, ...] | None = None
    source_kinds: tuple[str, ...] | None = None
    project: str | None = None
    channel: str | None = None
    max_age_days: int | None = None
    min_score: float | None = 0.0
    inferred_floor: float = 0.4


def reject_reason(policy: Policy, now: Column) -> Column:
    """The first test that a candidate fails, or null."""
    tests: list[tuple[Column, Column]] = [(F.col("chunk_found").isNull(), F.lit("missing_chunk_row")), (F.col("status").isNull(), F.lit("missing_memory_row"))]
    tests.append((~F.col("status").isin(*policy.statuses), F.concat(F.lit("status:"), F.col("status"))))
    if policy.types is not None:
        tests.append((~F.col("memory_type").isin(*policy.types), F.concat(F.lit("type:"), F.col("memory_type"))))
    if policy.source_kinds is not None:
        tests.append((~F.col("source_kind").isin(*policy.source_kinds), F.concat(F.lit("sourceKind:"), F.col("source_kind"))))
    for name, wanted in (("project", policy.project), ("channel", policy.channel)):
        if wanted is not None:
            tests.append((~F.col(name).eqNullSafe(F.lit(wanted)), F.concat(F.lit(f"{name}:"), F.coalesce(name, F.lit("none")))))
    tests.append(((F.col("source_kind") == "assistant_inferred") & (F.col("confidence") < policy.inferred_floor), F.lit("low_confidence_inferred")))
    if policy.max_age_days is not None and policy.max_age_days > 0:
        tests.append((F.col("moment").isNull(), F.lit("bad_timestamp")))
        age = (F.unix_micros(now) - F.unix_micros("moment")) / 86_400_000_000
        tests.append((age > policy.max_age_days, F.lit(f"older_than_{policy.max_age_days}d")))
    floor = F.col("min_score") if policy.min_score is None else F.lit(policy.min_score)
    tests.append((F.col("score") < floor, F.concat(F.lit("below_min_score:"), F.format_string("%.3f", F.col("score")))))
    return F.coalesce(*[F.when(test, reason) for test, reason in tests])


def judged(hits: DataFrame, chunks: DataFrame, memories: DataFrame, policy: Policy, now: Column) -> DataFrame:
    """Hits with their chunk, memory and ``reason``; two joins in place of a lookup for each hit.

    ``memories`` has ``moment`` (timestamp) for the age test.  Chunks and memories
    carry texts, whose size Spark estimates far too low: neither is broadcast.
    """
    c = chunks.select("chunk_id", "memory_id", "text", "source_path", "line_start", "line_end", F.lit(True).alias("chunk_found"))
    said = F.col("json") if "json" in memories.columns else F.lit(None).cast("string").alias("json")
    m = memories.select("memory_id", "memory_type", "status", "source_kind", "project", "channel", "confidence", "importance", "moment", said)
    return hits.join(c.hint("merge"), "chunk_id", "left").join(m.hint("merge"), "memory_id", "left").withColumn("reason", reject_reason(policy, now))


def debug_counts(judged_hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``query_id, hits, kept, semantic_hits, lexical_hits, rejected``; the last lists ``key:reason``, ordered by key and joined by ``|``.

    A query has at most twice the top n hits, so the list has a bound.
    """
    lost = F.when(F.col("reason").isNotNull(), F.struct(F.col(key), F.concat_ws(":", F.col(key), "reason").alias("said")))
    return judged_hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("semantic_rank").alias("semantic_hits"), F.count("lexical_rank").alias("lexical_hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(lost)), lambda x: x["said"]), "|").alias("rejected"),
    )


def best_of_memory(kept: DataFrame) -> DataFrame:
    """The best chunk of each memory, the first in the order of the fusion."""
    w = Window.partitionBy("query_id", "memory_id").orderBy(*_order(), "chunk_id")
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(rows: DataFrame, k: str | int = 5) -> DataFrame:
    """The first ``k`` of each query (a number or a column), with ``position``."""
    w = Window.partitionBy("query_id").orderBy(*_order(), "chunk_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= (k if isinstance(k, int) else F.col(k)))


def why_matched(now: Column) -> Column:
    """The reasons for a result, in a fixed order; needs ``query`` beside the result's columns."""
    token = F.try_element_at(F.filter(query_tokens(F.lower("query")), lambda t: F.contains(F.lower(F.col("text")), t)), F.lit(1))
    age = (F.unix_micros(now) - F.unix_micros("moment")) / 86_400_000_000
    tags = [
        F.when(F.col("semantic_rank").isNotNull(), "semantic_similarity"),
        F.when(F.col("lexical_rank").isNotNull(), "lexical_match"),
        F.when(F.col("lexical_rank").isNotNull(), F.concat(F.lit("lexical_match:"), token)),
        F.when(age.between(0, 30), "recent_within_30d"),
        F.when(F.col("importance") >= 0.7, "high_importance"),
        F.when(F.col("source_kind") == "human_confirmed", "human_confirmed"),
        F.when(F.length("project") > 0, F.concat(F.lit("project_match:"), F.col("project"))),
    ]
    return F.array_compact(F.array(*tags))


def result_summary(record: Column, text: Column, size: int = 200) -> Column:
    """The record's summary, else its title, else the first ``size`` characters of the text on one line.

    ``record`` is JSON; where it is broken, or both fields are missing or blank, the text counts.
    """
    ok = F.try_parse_json(record).isNotNull()
    field = lambda name: F.when(ok, F.get_json_object(record, f"$.{name}"))
    filled = lambda c: F.when(F.length(trim_space(c)) > 0, c)
    return F.coalesce(filled(field("summary")), filled(field("title")), trim_space(F.regexp_replace(F.left(text, F.lit(size)), f"{SPACE}+", " ")))


def assembled(results: DataFrame, now: Column) -> DataFrame:
    """``query_id, position, memory_id, memory_type, chunk_id, summary, citation, score, confidence, why`` of final results."""
    cited = citation(F.col("source_path"), F.col("line_start"), F.col("line_end"))
    summary = result_summary(F.col("json"), F.col("text"))
    return results.select(
        "query_id", "position", "memory_id", "memory_type", "chunk_id", summary.alias("summary"), cited.alias("citation"),
        round_half_up(F.col("score"), 4).alias("score"), "confidence", F.array_join(why_matched(now), "|").alias("why"),
    )
