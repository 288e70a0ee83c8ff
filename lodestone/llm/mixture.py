"""Mixing sources to target weights by Pareto order sampling.

Each source gets a budget of tokens.  A document's expected number of uses is its
source's budget over the source's tokens, weighted so that a text that recurs under
several ids counts less; the whole part is allocated outright, the fraction is the
document's inclusion probability.  Documents are ranked by the odds of a random
number over the odds of that probability, and the lowest ranks are taken until the
source's budget is filled: a sample of fixed size with unequal probabilities.

The cut in the ranking is found from two histograms, never by sorting a source in
one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import cut

#: Where the public tokenizers' files are; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_BINS = 4096


def canonical_source(c: Column) -> Column:
    """One spelling of a source name: lower case, trimmed, words joined by underscores."""
    return F.regexp_replace(F.lower(F.btrim(c)), r"[\s\-]+", "_")


def count_tokens(path: str = TOKENIZER):
    """A column function: number of tokens of a text (null and empty: 0)."""

    @F.pandas_udf("long")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("public", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return column


def measured(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document with tokens and a source.

    ``copies`` is the number of documents with the same text in the same source.
    Texts are tokenized where they are read; only a hash of them is shuffled, and
    the counts of copies are combined in the map tasks first.
    """
    each = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), F.xxhash64("text").alias("_text"), count_tokens(tokenizer)(F.col("text")).alias("tokens"))
    each = cut(each.where("source is not null and source <> '' and tokens > 0 and doc_id is not null"))
    copies = each.groupBy("source", "_text").agg(F.count(F.lit(1)).alias("copies"))
    return each.join(copies, ["source", "_text"]).select("doc_id", "source", "tokens", "copies")


def _uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key alone."""
    return (F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _crossing(ranked: DataFrame, bins: str) -> DataFrame:
    """For each source the first bin at which the running tokens reach ``need``, and what comes before.

    The window runs over at most ``2 * _BINS`` rows for each source.
    """
    per_bin = ranked.groupBy("source", "need", bins).agg(F.sum("tokens").alias("_in_bin"))
    running = per_bin.withColumn("_up_to", F.sum("_in_bin").over(Window.partitionBy("source").orderBy(bins)))
    crossed = running.where(F.col("_up_to") >= F.col("need"))
    return crossed.groupBy("source").agg(F.min_by(F.struct(F.col(bins).alias("edge"), (F.col("_up_to") - F.col("_in_bin")).alias("before")), bins).alias("c")).select("source", "c.*")


def plan_budgets(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: ``source, target_share, max_repeats, have, budget, share``.

    ``share`` is the target share among the sources that have documents.  Without
    ``total_tokens`` the mix is as large as it can be with every share met: the
    least over the sources of ``have x max_repeats / share``.  With it, a source
    that can't fill its budget gives all it has.  A few rows: one for each target.
    """
    goals = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.sum(F.col("tokens") / F.sqrt("copies")).alias("weighted"), F.max(F.lit(1) / F.sqrt("copies")).alias("top"))
    both = goals.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    everything = Window.partitionBy(F.lit(1))
    both = both.withColumn("share", F.when(F.col("have") > 0, F.col("target_share") / F.sum(F.when(F.col("have") > 0, F.col("target_share"))).over(everything)))
    room = F.col("have") * F.col("max_repeats")
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.min(room / F.col("share")).over(everything)
    return both.withColumn("budget", F.coalesce(F.least(size * F.col("share"), room), F.lit(0.0)))


def draw_mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``doc_id, source, tokens, copies_used`` of every document used at least
    once; ``copies_used`` is at most the source's ``max_repeats``.  Report: one row
    for each target source with ``target_share, max_repeats, tokens_available,
    tokens_used, actual_share, documents_used``; a source without documents has 0.

    Sources are compared in their canonical spelling; documents of no target
    source, without text or with a null id or source are not used.  The draw
    depends on ids and ``seed`` alone, so it is the same in any partitioning.
    A source's tokens miss its budget by less than one document.
    """
    docs = cut(measured(documents, tokenizer))
    budgets = cut(plan_budgets(docs, targets, total_tokens))
    # One row for each target source; Spark broadcasts it if it is as small as it should be.
    base = docs.join(budgets.where("budget > 0").select("source", "budget", "have", "weighted", "max_repeats"), "source")
    # Uses in proportion to 1/sqrt(copies), pulled towards even use as the source nears its maximum.
    even = F.col("budget") / F.col("have")
    slack = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("max_repeats") - even) / F.greatest(even, F.lit(1e-12)))
    tilt = F.lit(1.0) + slack * (F.lit(1) / F.sqrt("copies") * F.col("have") / F.col("weighted") - 1)
    expected = F.least(F.col("max_repeats").cast("double"), even * tilt)
    base = base.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("pi", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    certain = base.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("certain_tokens"))
    u = _uniform(F.col("doc_id"), seed)
    # The order of the Pareto ranks is kept by any increasing map of them to (0, 1); documents without odds come behind, spread over (1, 2).
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    rank = F.when((F.col("pi") > 1e-9) & (F.col("whole") < F.col("max_repeats")), odds / (1 + odds)).otherwise(F.when(F.col("whole") < F.col("max_repeats"), 1 + u))
    ranked = base.join(certain, "source").withColumn("need", F.col("budget") - F.col("certain_tokens")).withColumn("rank", rank)
    ranked = cut(ranked.select("doc_id", "source", "tokens", "whole", "need", "rank"))

    open_docs = ranked.where("need > 0 and rank is not null").withColumn("bin", F.least(F.floor(F.col("rank") * _BINS), F.lit(2 * _BINS - 1)))
    first = _crossing(open_docs, "bin").select("source", F.col("edge").alias("edge_1"), F.col("before").alias("before_1"))
    inside = open_docs.join(first, "source").where("bin = edge_1").withColumn("need", F.col("need") - F.col("before_1"))
    inside = inside.withColumn("fine", F.least(F.floor((F.col("rank") * _BINS - F.col("bin")) * _BINS), F.lit(_BINS - 1)))
    second = _crossing(inside.drop("bin"), "fine").select("source", F.col("edge").alias("edge_2"), F.col("before").alias("before_2"))
    # What is left is one 1/16,777,216 of the ranks of a source; there the rows themselves are ordered.
    last = inside.join(second, "source").where("fine = edge_2").withColumn("_run", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id")))
    last = last.where(F.col("_run") - F.col("tokens") / 2 <= F.col("need") - F.col("before_2")).select("source", "doc_id", F.lit(True).alias("_at_edge"))

    edges = first.join(second, "source", "left")
    marked = ranked.join(edges, "source", "left").join(last, ["source", "doc_id"], "left")
    position = F.least(F.floor(F.col("rank") * _BINS), F.lit(2 * _BINS - 1))
    fine = F.least(F.floor((F.col("rank") * _BINS - position) * _BINS), F.lit(_BINS - 1))
    below = (position < F.col("edge_1")) | ((position == F.col("edge_1")) & (fine < F.col("edge_2")))
    # Where even all ranks don't reach the need, there is no edge and every open document is used.
    chosen = F.col("rank").isNotNull() & (F.col("need") > 0) & (F.col("edge_1").isNull() | below | F.coalesce("_at_edge", F.lit(False)))
    mix = marked.select("doc_id", "source", "tokens", (F.col("whole") + chosen.cast("long")).cast("int").alias("copies_used")).where("copies_used > 0")
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies_used")).alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"))
    report = budgets.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("have").alias("tokens_available"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
    )
    return mix, report
