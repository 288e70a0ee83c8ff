"""Batches of questions against a store: its vectors, postings, chunks and memories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.timestamps import parse_timestamp, wall_to_utc
from lodestone.operators import retrieval
from lodestone.operators.lexical import rank_bm25
from lodestone.operators.store import Store
from lodestone.operators.vector import nearest, stub_vector
from lodestone.session import cut


def moment_of(timestamp: Column) -> Column:
    """The instant that a record's time denotes; a time without a zone is UTC, no time gives null."""
    p = parse_timestamp(timestamp, F.lit("dmy"))
    local = p["wall_micros"] - F.coalesce(p["offset_minutes"], F.lit(0)) * 60_000_000
    zoned = F.when(p["zone"].isNotNull(), wall_to_utc(p["wall_micros"], p["zone"])).otherwise(local)
    return F.timestamp_micros(F.coalesce(p["epoch_micros"], zoned))


def search(
    store: Store,
    queries: DataFrame,
    now: Column,
    policy: retrieval.Policy = retrieval.Policy(min_score=None),
    top_k: int = 5,
    top_n: int = 40,
    embed: Callable[[Column], Column] | None = None,
    audited: bool = True,
) -> DataFrame:
    """The cited results of each question: the columns of ``retrieval.assembled``.

    ``queries`` has ``query_id, query`` and may have ``k`` and ``min_score``.  The
    stored postings are filtered by the terms of the questions, the stored vectors
    are read once for all questions.  With ``audited`` one record for each question
    is appended to the store's audit.
    """
    embed = embed or (lambda c: stub_vector(c, int(store.meta()["embedding_dim"])))
    asked = cut(retrieval.normalised(queries, top_k))
    semantic = nearest(store.read("vectors"), asked.select("query_id", embed(F.col("query")).alias("vector")), top_n)
    lexical = rank_bm25(store.read("postings"), store.read("lengths"), asked, top_n)
    hits = retrieval.fuse(semantic, lexical).join(asked, "query_id")
    memories = store.read("memories").withColumn("moment", moment_of(F.col("timestamp")))
    judged = cut(retrieval.judged(hits, store.read("chunks"), memories, policy, now))
    kept = retrieval.best_of_memory(judged.where("reason is null"))
    results = cut(retrieval.assembled(retrieval.top_k(kept, "k"), now))
    if audited:
        store.append_audits(retrieval_records(asked, judged, results, top_n))
    return results


def retrieval_records(asked: DataFrame, judged: DataFrame, results: DataFrame, top_n: int) -> DataFrame:
    """``kind, payload_json``: what was asked, found and rejected, one record for each question."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(F.col("memory_id").alias("memoryId"), "score", F.split("why", r"\|").alias("whyMatched")).alias("r")))), lambda x: x["r"])
    found = results.groupBy("query_id").agg(listed.alias("results"))  # at most k results each
    rejected = judged.where("reason is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    each = asked.join(found, "query_id", "left").join(rejected, "query_id", "left")
    none = F.array().cast(found.schema["results"].dataType)
    payload = F.struct("query", F.col("k").alias("topK"), F.lit(top_n).alias("topN"), F.coalesce("results", none).alias("results"), F.coalesce("n", F.lit(0)).alias("rejectedCount"))
    return each.select(F.lit("retrieve").alias("kind"), F.to_json(payload).alias("payload_json"))
