"""Retrieval quality: hits, reports by intent, trust and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import has_secret, round_half_up


def case_runs(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row a case: ``case_id, intent, n_results, hit_rank, citations_ok, tokens``.

    A hit is any expected memory; an empty result list has valid citations.
    ``results`` has ``case_id, position, memory_id, citation, summary``.
    """
    expected = cases.select("case_id", F.explode("expected_memory_ids").alias("memory_id")).distinct().withColumn("wanted", F.lit(True))
    shaped = F.col("citation").rlike(r"^.+\.md(?:#L\d+(?:-L\d+)?)?$")
    cost = F.ceil((F.length("summary") + F.length("citation")) / 4)
    runs = results.join(expected, ["case_id", "memory_id"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.min(F.when(F.col("wanted"), F.col("position"))).alias("hit_rank"),
        F.bool_and(F.coalesce(shaped, F.lit(False))).alias("citations_ok"),
        F.sum(cost).alias("tokens"),
    )
    return cases.select("case_id", "intent").join(runs, "case_id", "left").select("case_id", "intent", F.coalesce("n_results", F.lit(0)).alias("n_results"), "hit_rank", F.coalesce("citations_ok", F.lit(True)).alias("citations_ok"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def report(runs: DataFrame, *by: str) -> DataFrame:
    """Hit rate at k, mean reciprocal rank (a miss counts 0), citation shape and average tokens."""
    mean = lambda c, name: F.coalesce(F.round(F.avg(c), 9), F.lit(0.0)).alias(name)
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("hit_rank").isNotNull()).alias("hits"),
        mean(F.col("hit_rank").isNotNull().cast("double"), "hit_rate_at_k"),
        mean(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0)), "mrr"),
        mean(F.col("citations_ok").cast("double"), "citation_shape_ok"),
        mean(F.col("tokens").cast("double"), "avg_tokens"),
    )


def latest_labels(labels: DataFrame) -> DataFrame:
    """The verdict that holds for each case: the last one given."""
    return labels.where("case_id is not null").groupBy("case_id").agg(F.max_by("verdict", F.struct("labeled_at", "verdict")).alias("verdict"))


def trust(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """``labeled, wrong, false_memory_rate`` over the cases that have a label (rate null if none has)."""
    known = cases.select("case_id").join(latest_labels(labels), "case_id")
    wrong = F.count_if(F.col("verdict") == "wrong")
    return known.agg(F.count(F.lit(1)).alias("labeled"), wrong.alias("wrong"), F.round(F.try_divide(wrong.cast("double"), F.count(F.lit(1))), 9).alias("false_memory_rate"))


def trust_issues(results: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_id, issues, citation_violations, secret_hits`` of the cases that have an issue.

    ``results`` has ``case_id, position, memory_id, citation, summary``.  Issues are
    in the order of the results, a missing, empty or many-line citation before a
    secret in the summary; a label ``wrong`` or ``partial`` comes last.
    """
    bad = ~F.coalesce(F.col("citation").rlike(r"^[^\n\r\x{2028}\x{2029}]+$"), F.lit(False))
    secret = F.coalesce(has_secret(F.col("summary")), F.lit(False))
    found = F.array_compact(F.array(F.when(bad, F.concat(F.lit("bad_citation:"), "memory_id")), F.when(secret, F.concat(F.lit("secret_in_summary:"), "memory_id"))))
    # At most k results for each case, which a query states itself.
    each = results.where(bad | secret).groupBy("case_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", found.alias("issues")))), lambda x: x["issues"])).alias("issues"),
        F.count_if(bad).alias("citation_violations"), F.count_if(secret).alias("secret_hits"),
    )
    said = latest_labels(labels).where(F.col("verdict").isin("wrong", "partial")).select("case_id", F.concat(F.lit("human_label:"), "verdict").alias("said"))
    both = cases.select("case_id").join(each, "case_id", "left").join(said, "case_id", "left")
    issues = F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.array_compact(F.array("said")))
    return both.select("case_id", issues.alias("issues"), F.coalesce("citation_violations", F.lit(0)).alias("citation_violations"), F.coalesce("secret_hits", F.lit(0)).alias("secret_hits")).where(F.size("issues") > 0)


def trust_report(cases: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``total_cases, citation_violations, secret_hits, labeled, wrong, false_memory_rate``."""
    total = cases.agg(F.count(F.lit(1)).alias("total_cases"))
    counts = trust_issues(results, labels, cases).agg(F.coalesce(F.sum("citation_violations"), F.lit(0)).alias("citation_violations"), F.coalesce(F.sum("secret_hits"), F.lit(0)).alias("secret_hits"))
    return total.crossJoin(counts).crossJoin(trust(cases, labels))  # one row each


def index_age(audit: DataFrame, now: Column, warn_hours: int = 24) -> DataFrame:
    """One row: ``last_rebuild, age_seconds, status`` (``warn`` where the last rebuild is older than ``warn_hours``, or there is none)."""
    last = audit.where("kind = 'rebuild'").agg(F.max("ts").alias("last_rebuild"))
    age = F.round((F.unix_micros(now) - F.unix_micros("last_rebuild")) / 1_000_000).cast("long")
    return last.select("last_rebuild", age.alias("age_seconds"), F.when(age <= warn_hours * 3600, "ok").otherwise("warn").alias("status"))


def zero_results(audit: DataFrame, now: Column, hours: int = 24, warn_above: float = 0.3) -> DataFrame:
    """One row: ``retrievals, empty, rate, status`` of the retrievals of the last ``hours``.

    A payload that is broken, or has no list of results, counts as empty.  Without
    retrievals the rate is null and the status ``ok``.
    """
    recent = audit.where("kind = 'retrieve'").where(F.unix_micros("ts") >= F.unix_micros(now) - hours * 3_600_000_000)
    ok = F.try_parse_json("payload_json").isNotNull()
    size = F.coalesce(F.when(ok, F.json_array_length(F.get_json_object("payload_json", "$.results"))), F.lit(0))
    counts = recent.agg(F.count(F.lit(1)).alias("retrievals"), F.count_if(size == 0).alias("empty"))
    share = F.try_divide(F.col("empty").cast("double"), F.col("retrievals"))
    return counts.select("retrievals", "empty", round_half_up(share, 3).alias("rate"), F.when(share > warn_above, "warn").otherwise("ok").alias("status"))


def mentions(audit: DataFrame) -> DataFrame:
    """``memory_id, id, ts, kind``: which audit records name which memory, as a result or as their subject."""
    ok = audit.where(F.try_parse_json("payload_json").isNotNull())
    named = F.concat(F.coalesce(F.from_json("payload_json", "struct<results:array<struct<memoryId:string>>>")["results"]["memoryId"], F.array().cast("array<string>")), F.array(F.get_json_object("payload_json", "$.memoryId")))
    return ok.select(F.explode(F.array_distinct(F.array_compact(named))).alias("memory_id"), "id", "ts", "kind")


def explained(memories: DataFrame, chunks: DataFrame, audit: DataFrame, recent: int = 5) -> DataFrame:
    """One row for each memory: ``memory_id, status, n_chunks, first_line, last_line, n_mentions, recent_audit``.

    ``recent_audit`` are the ids of the ``recent`` latest audit records that name the
    memory, latest first, joined by ``|``; only these are gathered.
    """
    per = chunks.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"))
    named = mentions(audit)
    counts = named.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    ranked = named.withColumn("_r", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("_r") <= recent)
    latest = ranked.groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]), "|").alias("recent_audit"))
    all_of = memories.select("memory_id", "status").join(per, "memory_id", "left").join(counts.join(latest, "memory_id", "left"), "memory_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_of.select("memory_id", "status", zero("n_chunks"), "first_line", "last_line", zero("n_mentions"), F.coalesce("recent_audit", F.lit("")).alias("recent_audit"))


def gates(overall: DataFrame, trusted: DataFrame, hit_rate: float = 0.85, citations: float = 0.95, tokens: float = 200, false_memory: float = 0.05) -> DataFrame:
    """``passed, failures``; false memories count only where labels exist, no cases fail."""
    one = overall.crossJoin(trusted)  # two one-row reports
    failures = F.array_compact(
        F.array(
            F.when(F.col("cases") == 0, "no_cases"),
            F.when(F.col("hit_rate_at_k") < hit_rate, "hit_rate"),
            F.when(F.col("citation_shape_ok") < citations, "citations"),
            F.when(F.col("avg_tokens") > tokens, "tokens"),
            F.when(F.col("false_memory_rate") > false_memory, "false_memory"),
        )
    )
    return one.select((F.size(failures) == 0).alias("passed"), F.array_join(failures, "|").alias("failures"))


def stale_ranges(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``chunks, file_missing, range_beyond, stale_share`` (one row) of chunks that name lines.

    ``files`` has ``path, text``; a range is stale if its file is gone or has fewer
    lines than ``line_end``.  Chunks without ``line_end`` are stale only where the
    file is gone.  All chunks count, none is sampled; without chunks the share is null.
    """
    sizes = files.groupBy("path").agg(F.max(F.size(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1))).alias("n_lines"))
    each = chunks.select("source_path", "line_end").join(sizes, F.col("source_path") == F.col("path"), "left")
    gone, beyond = F.col("n_lines").isNull(), F.coalesce(F.col("line_end") > F.col("n_lines"), F.lit(False))
    counts = each.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(gone).alias("file_missing"), F.count_if(beyond).alias("range_beyond"))
    return counts.withColumn("stale_share", F.try_divide(F.col("file_missing") + F.col("range_beyond"), F.col("chunks")))
