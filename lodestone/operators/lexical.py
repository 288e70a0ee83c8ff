"""Full-text search: postings, phrases and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import index_tokens, query_tokens


def query_phrases(queries: DataFrame) -> DataFrame:
    """``query_id, phrase, i, term, size``: each token of a question is a phrase of index terms.

    A token such as ``content-adapter`` is a phrase of two adjacent terms.  Repeated
    tokens are phrases of their own and count again.
    """
    tokens = queries.select("query_id", F.posexplode(query_tokens(F.col("query"))).alias("phrase", "token"))
    terms = tokens.select("query_id", "phrase", index_tokens(F.col("token")).alias("terms"))
    return terms.select("query_id", "phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("i", "term"))


def tokenised(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, terms``: the index terms of each chunk in order."""
    return chunks.where(F.col(text).isNotNull()).select(key, index_tokens(F.col(text)).alias("terms"))


def postings_of(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``term, key, pos, n_terms``: every place of every term; ``n_terms`` is the length of its chunk."""
    return tokens.select(key, F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "term")).select("term", key, "pos", "n_terms")


def lengths_of(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, n_terms`` of every chunk, also of those without terms."""
    return tokens.select(key, F.size("terms").alias("n_terms"))


def rank_bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, top_n: int | None = 40, k1: float = 1.2, b: float = 0.75, key: str = "chunk_id", most_terms: int = 1000) -> DataFrame:
    """``query_id, key, score, rank`` of the best ``top_n`` chunks of each query (lower is better).

    ``postings`` and ``lengths`` are tables of the index.  The score is that of
    SQLite's FTS5.  A posting is shuffled only if its term is in a query, and then
    with its place alone; ties go by ``key``.  Up to ``most_terms`` terms of the
    questions also go into the scan as a filter, which skips files and row groups of
    postings that are clustered by term.
    """
    phrases = query_phrases(queries)
    wanted = phrases.select("term").distinct()
    terms = [r["term"] for r in wanted.limit(most_terms + 1).collect()]
    if len(terms) <= most_terms:
        postings = postings.where(F.col("term").isin(terms))
    corpus = lengths.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
    # Placed once by question and chunk, so that the three aggregates by more than these need no shuffle of their own.
    met = postings.join(wanted, "term", "left_semi").join(phrases, "term").repartition("query_id", key)
    found = met.groupBy("query_id", "phrase", "size", key, "n_terms", (F.col("pos") - F.col("i")).alias("at")).agg(F.count(F.lit(1)).alias("met"))
    frequency = found.where("met = size").groupBy("query_id", "phrase", key, "n_terms").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = frequency.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weighed = frequency.join(df, ["query_id", "phrase"]).crossJoin(F.broadcast(corpus))  # one row
    raw = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("avg_terms")))
    scored = weighed.groupBy("query_id", key).agg((-F.round(F.sum(part), 9)).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", key)))
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked


def bm25(chunks: DataFrame, queries: DataFrame, top_n: int | None = 40, k1: float = 1.2, b: float = 0.75, key: str = "chunk_id") -> DataFrame:
    """``rank_bm25`` over chunks that have no index: their terms are made here."""
    tokens = tokenised(chunks, key)
    return rank_bm25(postings_of(tokens, key), lengths_of(tokens, key), queries, top_n, k1, b, key)


def snippets(found: DataFrame, queries: DataFrame, size: int = 8, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``query_id, key, snippet``: up to ``size`` words of each found text around the first word that a question asks for.

    ``found`` has ``query_id, key, text``.  Words that hold an asked term are set in
    ``[ ]``; ``...`` marks what is left out.  A text without such a word gives its
    beginning; null and blank texts give an empty snippet.
    """
    asked = queries.select("query_id", F.flatten(F.transform(query_tokens(F.col("query")), index_tokens)).alias("_terms"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: F.length(w) > 0)
    each = found.join(asked, "query_id").select("query_id", key, words.alias("_words"), "_terms")
    hits = F.transform("_words", lambda w: F.arrays_overlap(index_tokens(w), F.col("_terms")))
    each = each.withColumn("_hits", hits)
    first = F.greatest(F.array_position("_hits", True), F.lit(1)).cast("int")
    start = F.greatest(F.lit(1), F.least(first - size // 2, F.size("_words") - size + 1))
    each = each.withColumn("_start", start)
    shown = F.transform(F.slice(F.arrays_zip("_words", "_hits"), F.col("_start"), F.lit(size)), lambda x: F.when(x["_hits"], F.concat(F.lit("["), x["_words"], F.lit("]"))).otherwise(x["_words"]))
    before = F.when(F.col("_start") > 1, F.lit("...")).otherwise(F.lit(""))
    after = F.when(F.col("_start") + size <= F.size("_words"), F.lit("...")).otherwise(F.lit(""))
    return each.select("query_id", key, F.concat(before, F.array_join(shown, " "), after).alias("snippet"))
