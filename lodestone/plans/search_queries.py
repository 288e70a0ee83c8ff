"""Registered queries on search and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import has_secret
from lodestone.operators import evaluate, retrieval, store
from lodestone.operators.lexical import lengths_of, postings_of, query_phrases, rank_bm25, snippets, tokenised
from lodestone.operators.vector import nearest, stub_vector
from lodestone.plans.index_queries import _AUDIT, _SP, _TRIM, NOW, audit_log
from lodestone.session import written
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: The terms of a folder's chunks, written once for an application.
_INDEX: dict[tuple[str, str], DataFrame] = {}


def _now() -> Column:
    return F.lit(f"{NOW}+00:00").cast("timestamp")

def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _bench(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.normalised(table(spark, folder, "phase1_bench").withColumnRenamed("id", "query_id"), drop_empty=True)


def index_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The postings and lengths of a folder's chunks.

    Their terms are written to the shared folder once; the queries of an application,
    which takes a folder's tables as they are, read them from there.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEX:
        _INDEX[key] = written(tokenised(table(spark, folder, "chunks")))
    return postings_of(_INDEX[key]), lengths_of(_INDEX[key])


_SPLIT = "'[\\s,.;:!?()''\"`，。；：！？（）]+'"
_TERMS = lambda c: f"list_filter(string_split_regex(regexp_replace(strip_accents(lower({c})), '\\p{{Mn}}+', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: length(t) > 0)"
_PHRASES = f"""
tok AS (SELECT id AS query_id, list_filter(string_split_regex(query, {_SPLIT}), lambda t: length(t) >= 2) AS ts FROM phase1_bench),
tk AS (SELECT query_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS phrase FROM tok),
ph0 AS (SELECT query_id, phrase, {_TERMS('token')} AS terms FROM tk),
phrases AS (SELECT query_id, phrase, len(terms) AS size, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS i FROM ph0)"""
_BM25 = f"""
{_PHRASES},
docs AS (SELECT chunk_id, {_TERMS('text')} AS terms FROM chunks),
corpus AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(terms)) AS avg_terms FROM docs),
post AS (SELECT chunk_id, len(terms) AS n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM docs),
met AS (SELECT query_id, phrase, size, chunk_id, n_terms, pos - i AS at, count(*) AS met FROM post JOIN phrases USING (term) GROUP BY ALL),
freq AS (SELECT query_id, phrase, chunk_id, n_terms, count(*)::DOUBLE AS tf FROM met WHERE met = size GROUP BY ALL),
dfs AS (SELECT query_id, phrase, count(*)::DOUBLE AS df FROM freq GROUP BY ALL),
part AS (SELECT query_id, chunk_id, CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / avg_terms)) AS s FROM freq JOIN dfs USING (query_id, phrase), corpus),
scored AS (SELECT query_id, chunk_id, -round(sum(s), 9) AS score FROM part GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id)::INT AS rank FROM scored QUALIFY rank <= 40)"""
_HEX = lambda h, i: f"('0x' || substr({h},{8 * i + 7},2) || substr({h},{8 * i + 5},2) || substr({h},{8 * i + 3},2) || substr({h},{8 * i + 1},2))::BIGINT"
_STUB = lambda c: "[" + ", ".join(f"(CASE WHEN {_HEX(c, i)} >= 2147483648 THEN {_HEX(c, i)} - 4294967296 ELSE {_HEX(c, i)} END)::DOUBLE / 2147483647.0::DOUBLE" for i in range(8)) + "]"
_KNN = f"""
qv AS (SELECT query_id, {_STUB('h')} AS q FROM (SELECT id AS query_id, sha256('0' || chr(0) || query) AS h FROM phase1_bench)),
cv AS (SELECT chunk_id, {_STUB('h')} AS v FROM (SELECT chunk_id, sha256('0' || chr(0) || text) AS h FROM chunks)),
dist AS (SELECT query_id, chunk_id, round(list_distance(v, q), 9) AS distance FROM cv, qv),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM dist QUALIFY rank <= 40)"""
_FUSED = f"""{_BM25}, {_KNN},
fused AS (SELECT coalesce(sem.query_id, lex.query_id) AS query_id, coalesce(sem.chunk_id, lex.chunk_id) AS chunk_id, sem.rank AS semantic_rank, lex.rank AS lexical_rank,
  coalesce(1.0::DOUBLE / (60 + sem.rank), 0) + coalesce(1.0::DOUBLE / (60 + lex.rank), 0) AS score
  FROM sem FULL JOIN lex ON sem.query_id = lex.query_id AND sem.chunk_id = lex.chunk_id)"""
_ORDER = "round(score, 12) DESC, semantic_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, chunk_id"
_JUDGED = f"""{_FUSED},
judged AS (SELECT f.*, c.memory_id, c.text, c.source_path, c.line_start, c.line_end, m.memory_type, m.confidence, m.json, m.status, m.source_kind, m.project, m.importance, m.created_at AS moment,
  CASE WHEN c.chunk_id IS NULL THEN 'missing_chunk_row' WHEN m.status IS NULL THEN 'missing_memory_row' WHEN m.status <> 'active' THEN 'status:' || m.status
   WHEN m.source_kind = 'assistant_inferred' AND m.confidence < 0.4 THEN 'low_confidence_inferred'
   WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(m.created_at) > 365 * 86400000000 THEN 'older_than_365d' END AS reason
  FROM fused f LEFT JOIN chunks c ON c.chunk_id = f.chunk_id LEFT JOIN memories m ON m.memory_id = c.memory_id)"""
_FILLED = lambda name: f"CASE WHEN length({_TRIM(f'json_extract_string(try_cast(json AS JSON), {chr(39)}$.{name}{chr(39)})')}) > 0 THEN json_extract_string(try_cast(json AS JSON), '$.{name}') END"
_SUMMARY = f"coalesce({_FILLED('summary')}, {_FILLED('title')}, {_TRIM(f"regexp_replace(left(text, 200), '{_SP}+', ' ', 'g')")})"
_TOP = f"""{_JUDGED},
best AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY query_id, memory_id ORDER BY {_ORDER}) = 1),
top AS (SELECT b.*, p.query, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER})::INT AS position, coalesce(p.k, 5) AS k FROM best b JOIN phase1_bench p ON p.id = b.query_id QUALIFY position <= coalesce(p.k, 5)),
cited AS (SELECT *, CASE WHEN line_start IS NOT NULL AND line_end IS NOT NULL THEN source_path || '#L' || line_start || '-L' || line_end ELSE source_path END AS citation FROM top)"""


def _lexical(spark, folder):
    return rank_bm25(*index_of(spark, folder), _bench(spark, folder))


def _semantic(spark, folder):
    vectors = table(spark, folder, "chunks").select("chunk_id", stub_vector(F.col("text")).alias("vector"))
    return nearest(vectors, _bench(spark, folder).select("query_id", stub_vector(F.col("query")).alias("vector")))


def _judged(spark, folder):
    memories = table(spark, folder, "memories").withColumn("moment", F.col("created_at"))
    fused = retrieval.fuse(_semantic(spark, folder), _lexical(spark, folder))
    return retrieval.judged(fused, table(spark, folder, "chunks"), memories, retrieval.Policy(max_age_days=365), _now())


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The final results of all bench queries with all their columns."""
    kept = retrieval.best_of_memory(_judged(spark, folder).where("reason is null"))
    return retrieval.top_k(kept.join(_bench(spark, folder), "query_id"), "k")


@query("o63_tokens", f"SELECT chunk_id, array_to_string({_TERMS('text')}, ' ') AS terms FROM chunks")
def o63(spark, folder):
    return tokenised(table(spark, folder, "chunks")).select("chunk_id", F.array_join("terms", " ").alias("terms"))


@query("o64_phrases", f"WITH {_PHRASES} SELECT query_id, phrase::INT AS phrase, size::INT AS size, i::INT AS i, term FROM phrases")
def o64(spark, folder):
    return query_phrases(_bench(spark, folder))


@query("o62_bm25", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex")
def o62(spark, folder):
    return _lexical(spark, folder).withColumn("score", F.round("score", 6))


@query("o51_stub_vector", f"SELECT chunk_id, list_transform({_STUB('h')}, lambda x: round(x, 9)) AS vector FROM (SELECT chunk_id, sha256('0' || chr(0) || text) AS h FROM chunks)")
def o51(spark, folder):
    return table(spark, folder, "chunks").select("chunk_id", F.transform(stub_vector(F.col("text")), lambda x: F.round(x, 9)).alias("vector"))


@query("o61_nearest", "SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 40")
def o61(spark, folder):
    e = table(spark, folder, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return nearest(e.select("vec_id", F.col("embedding").alias("vector")), q, 40, "vec_id").withColumn("distance", F.round("distance", 6))


@query("o65_fused", f"WITH {_FUSED} SELECT query_id, chunk_id, semantic_rank, lexical_rank, round(score, 9) AS score FROM fused")
def o65(spark, folder):
    return retrieval.fuse(_semantic(spark, folder), _lexical(spark, folder)).withColumn("score", F.round("score", 9))


@query("o80_rejections", f"WITH {_JUDGED} SELECT query_id, chunk_id, coalesce(reason, 'kept') AS outcome FROM judged")
def o80(spark, folder):
    return _judged(spark, folder).select("query_id", "chunk_id", F.coalesce("reason", F.lit("kept")).alias("outcome"))


_SCOPED = retrieval.Policy(("active", "archived"), ("episode", "decision", "fact"), ("human_confirmed", "compiled", "assistant_inferred"), "amber-relay", "ops-berlin")
_AGED = retrieval.Policy(("active", "archived", "superseded"), max_age_days=180, min_score=0.5)


@query(
    "o81_policies",
    f"""SELECT c.chunk_id, CASE WHEN m.status IS NULL THEN 'missing_memory_row' WHEN m.status NOT IN ('active', 'archived') THEN 'status:' || m.status
  WHEN m.memory_type NOT IN ('episode', 'decision', 'fact') THEN 'type:' || m.memory_type
  WHEN m.source_kind NOT IN ('human_confirmed', 'compiled', 'assistant_inferred') THEN 'sourceKind:' || m.source_kind
  WHEN m.project IS DISTINCT FROM 'amber-relay' THEN 'project:' || coalesce(m.project, 'none')
  WHEN m.channel IS DISTINCT FROM 'ops-berlin' THEN 'channel:' || coalesce(m.channel, 'none')
  WHEN m.source_kind = 'assistant_inferred' AND m.confidence < 0.4 THEN 'low_confidence_inferred' ELSE 'kept' END AS scoped,
 CASE WHEN m.status IS NULL THEN 'missing_memory_row' WHEN m.status NOT IN ('active', 'archived', 'superseded') THEN 'status:' || m.status
  WHEN m.source_kind = 'assistant_inferred' AND m.confidence < 0.4 THEN 'low_confidence_inferred' WHEN m.created_at IS NULL THEN 'bad_timestamp'
  WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(m.created_at) > 180 * 86400000000 THEN 'older_than_180d'
  WHEN m.importance < 0.5 THEN 'below_min_score' ELSE 'kept' END AS aged
FROM chunks c LEFT JOIN memories m ON m.memory_id = c.memory_id""",
)
def o81(spark, folder):
    """Every chunk under a policy of scopes and under one of age and score (its importance stands for the score)."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "memory_id", F.lit(True).alias("chunk_found"))
    memories = table(spark, folder, "memories").select("memory_id", "memory_type", "status", "source_kind", "project", "channel", "confidence", F.col("importance").alias("score"), F.col("created_at").alias("moment"))
    outcome = lambda policy: F.coalesce(F.regexp_replace(retrieval.reject_reason(policy, _now()), "^(below_min_score):.*", "$1"), F.lit("kept"))
    return chunks.join(memories, "memory_id", "left").select("chunk_id", outcome(_SCOPED).alias("scoped"), outcome(_AGED).alias("aged"))


@query("o71_debug", f"WITH {_JUDGED} SELECT query_id, count(*) AS hits, count(*) FILTER (reason IS NULL) AS kept, count(semantic_rank) AS semantic_hits, count(lexical_rank) AS lexical_hits, coalesce(string_agg(chunk_id || ':' || reason, '|' ORDER BY chunk_id) FILTER (reason IS NOT NULL), '') AS rejected FROM judged GROUP BY query_id")
def o71(spark, folder):
    return retrieval.debug_counts(_judged(spark, folder))


@query("o67_best_of_memory", f"WITH {_TOP} SELECT query_id, memory_id, chunk_id FROM best")
def o67(spark, folder):
    return retrieval.best_of_memory(_judged(spark, folder).where("reason is null")).select("query_id", "memory_id", "chunk_id")


@query("o68_top_k", f"WITH {_TOP} SELECT query_id, position, chunk_id FROM top")
def o68(spark, folder):
    return results(spark, folder).select("query_id", "position", "chunk_id")


_TOKEN = f"list_filter(string_split_regex(lower(query), {_SPLIT}), lambda t: length(t) >= 2 AND contains(lower(text), t))[1]"
_AGE = f"(epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(moment)) / 86400000000.0"


@query(
    "o70_results",
    f"""WITH {_TOP} SELECT query_id, position, memory_id, memory_type, chunk_id, {_SUMMARY} AS summary, confidence, citation, floor(score * 10000 + 0.5) / 10000 AS score,
    array_to_string(list_filter([CASE WHEN semantic_rank IS NOT NULL THEN 'semantic_similarity' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical_match' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical_match:' || {_TOKEN} END,
    CASE WHEN {_AGE} BETWEEN 0 AND 30 THEN 'recent_within_30d' END, CASE WHEN importance >= 0.7 THEN 'high_importance' END, CASE WHEN source_kind = 'human_confirmed' THEN 'human_confirmed' END, CASE WHEN length(project) > 0 THEN 'project_match:' || project END], lambda x: x IS NOT NULL), '|') AS why FROM cited""",
)
def o70(spark, folder):
    return retrieval.assembled(results(spark, folder), _now())


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.assembled(results(spark, folder), _now()).withColumnRenamed("query_id", "case_id")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each bench case with what its search found."""
    cases = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"), "intent", "expected_memory_ids")
    return evaluate.case_runs(cases, _found(spark, folder))


_RUNS = rf"""{_TOP},
summed AS (SELECT query_id, position, memory_id, citation, {_SUMMARY} AS summary FROM cited),
runs0 AS (SELECT s.query_id AS case_id, count(*) AS n_results, min(CASE WHEN list_contains(p.expected_memory_ids, s.memory_id) THEN position END) AS hit_rank,
 bool_and(regexp_matches(citation, '^.+\.md(#L\d+(-L\d+)?)?$')) AS citations_ok, sum(ceil((length(summary) + length(citation)) / 4.0)) AS tokens FROM summed s JOIN phase1_bench p ON p.id = s.query_id GROUP BY s.query_id),
runs AS (SELECT p.id AS case_id, p.intent, coalesce(n_results, 0) AS n_results, hit_rank, coalesce(citations_ok, true) AS citations_ok, coalesce(tokens, 0)::BIGINT AS tokens FROM phase1_bench p LEFT JOIN runs0 r ON r.case_id = p.id)"""
_REPORT = "count(*) AS cases, count(hit_rank) AS hits, round(avg((hit_rank IS NOT NULL)::INT::DOUBLE), 9) AS hit_rate_at_k, round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 9) AS mrr, round(avg(citations_ok::INT::DOUBLE), 9) AS citation_shape_ok, round(avg(tokens::DOUBLE), 9) AS avg_tokens"


@query("o95_case_runs", f"WITH {_RUNS} SELECT * FROM runs")
def o95(spark, folder):
    return runs(spark, folder)


@query("o98_report", f"WITH {_RUNS} SELECT {_REPORT} FROM runs")
def o98(spark, folder):
    return evaluate.report(runs(spark, folder))


@query("o99_report_by_intent", f"WITH {_RUNS} SELECT intent, {_REPORT} FROM runs GROUP BY intent")
def o99(spark, folder):
    return evaluate.report(runs(spark, folder), "intent")


_LABELS = "(SELECT case_id, max_by(verdict, (labeled_at, verdict)) AS verdict FROM phase1_labels WHERE case_id IS NOT NULL GROUP BY case_id)"
_TRUST = f"SELECT count(*) AS labeled, count(*) FILTER (verdict = 'wrong') AS wrong, round(count(*) FILTER (verdict = 'wrong')::DOUBLE / nullif(count(*), 0), 9) AS false_memory_rate FROM {_LABELS} l JOIN phase1_bench p ON p.id = l.case_id"


def _trust(spark, folder):
    cases = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"))
    return evaluate.trust(cases, table(spark, folder, "phase1_labels"))


@query("o34_case_labels", f"SELECT p.id AS case_id, l.verdict FROM phase1_bench p LEFT JOIN {_LABELS} l ON l.case_id = p.id")
def o34(spark, folder):
    cases = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"))
    return cases.join(evaluate.latest_labels(table(spark, folder, "phase1_labels")), "case_id", "left")


@query("o100_trust", _TRUST)
def o100(spark, folder):
    return _trust(spark, folder)


@query("o101_gates", f"WITH {_RUNS}, rep AS (SELECT {_REPORT} FROM runs), tr AS ({_TRUST}), f AS (SELECT list_filter([CASE WHEN cases = 0 THEN 'no_cases' END, CASE WHEN hit_rate_at_k < 0.85 THEN 'hit_rate' END, CASE WHEN citation_shape_ok < 0.95 THEN 'citations' END, CASE WHEN avg_tokens > 200 THEN 'tokens' END, CASE WHEN false_memory_rate > 0.05 THEN 'false_memory' END], lambda x: x IS NOT NULL) AS fs FROM rep, tr) SELECT len(fs) = 0 AS passed, array_to_string(fs, '|') AS failures FROM f")
def o101(spark, folder):
    return evaluate.gates(evaluate.report(runs(spark, folder)), _trust(spark, folder))


@query("o100_secrets", "SELECT chunk_id, regexp_matches(text, 'sk-[a-zA-Z0-9]{16,}|\\bAKIA[0-9A-Z]{16}\\b|-----BEGIN [A-Z ]+PRIVATE KEY-----|\\bxox[abp]-[A-Za-z0-9-]{10,}\\b') AS has_secret FROM chunks")
def o100_secrets(spark, folder):
    return table(spark, folder, "chunks").select("chunk_id", has_secret(F.col("text")).alias("has_secret"))


@query("o60_normalised", f"SELECT id AS query_id, {_TRIM('query')} AS query, coalesce(k, 5)::INT AS k, 0.0::DOUBLE AS min_score FROM phase1_bench")
def o60(spark, folder):
    return retrieval.normalised(table(spark, folder, "phase1_bench").withColumnRenamed("id", "query_id"))


@query("o30c_result_summary", f"SELECT chunk_id, {_SUMMARY} AS summary FROM (SELECT c.chunk_id, c.text, m.json FROM chunks c LEFT JOIN memories m USING (memory_id))")
def o30c(spark, folder):
    memories = table(spark, folder, "memories").select("memory_id", "json").hint("merge")
    return table(spark, folder, "chunks").join(memories, "memory_id", "left").select("chunk_id", retrieval.result_summary(F.col("json"), F.col("text")).alias("summary"))


@query("o87_min_score", "SELECT memory_id, CASE WHEN importance < 0.5 THEN 'below_min_score:' || printf('%.3f', importance) ELSE 'kept' END AS outcome FROM memories")
def o87(spark, folder):
    """The score test with its printed score; the importance stands for the score, all else passes."""
    memories = table(spark, folder, "memories").select("memory_id", F.lit(True).alias("chunk_found"), F.lit("active").alias("status"), F.lit("compiled").alias("source_kind"), F.lit(1.0).alias("confidence"), F.col("importance").alias("score"))
    return memories.select("memory_id", F.coalesce(retrieval.reject_reason(retrieval.Policy(min_score=0.5), _now()), F.lit("kept")).alias("outcome"))


_BAD = r"NOT coalesce(regexp_matches(citation, '^[^\n\r\x{2028}\x{2029}]+$'), false)"
_SECRET = r"coalesce(regexp_matches(summary, 'sk-[a-zA-Z0-9]{16,}|\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]+PRIVATE KEY-----|\bxox[abp]-[A-Za-z0-9-]{10,}\b'), false)"
_ISSUES = f"""WITH {_RUNS},
said AS (SELECT case_id, 'human_label:' || verdict AS said FROM {_LABELS} WHERE verdict IN ('wrong', 'partial')),
per AS (SELECT query_id AS case_id, string_agg(CASE WHEN {_BAD} THEN 'bad_citation:' || memory_id || CASE WHEN {_SECRET} THEN '|' ELSE '' END ELSE '' END || CASE WHEN {_SECRET} THEN 'secret_in_summary:' || memory_id ELSE '' END, '|' ORDER BY position) AS issues,
  count(*) FILTER ({_BAD}) AS citation_violations, count(*) FILTER ({_SECRET}) AS secret_hits FROM summed WHERE {_BAD} OR {_SECRET} GROUP BY query_id),
issues AS (SELECT p.id AS case_id, concat_ws('|', per.issues, said.said) AS issues, coalesce(citation_violations, 0) AS citation_violations, coalesce(secret_hits, 0) AS secret_hits
  FROM phase1_bench p LEFT JOIN per ON per.case_id = p.id LEFT JOIN said ON said.case_id = p.id WHERE per.issues IS NOT NULL OR said.said IS NOT NULL)"""


@query("o100_issues", f"{_ISSUES} SELECT * FROM issues")
def o100_issues(spark, folder):
    cases = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"))
    return evaluate.trust_issues(_found(spark, folder), table(spark, folder, "phase1_labels"), cases).withColumn("issues", F.array_join("issues", "|"))


@query("o100_trust_report", f"{_ISSUES}, t AS ({_TRUST}) SELECT (SELECT count(*) FROM phase1_bench) AS total_cases, (SELECT coalesce(sum(citation_violations), 0)::BIGINT FROM issues) AS citation_violations, (SELECT coalesce(sum(secret_hits), 0)::BIGINT FROM issues) AS secret_hits, labeled, wrong, false_memory_rate FROM t")
def o100_report(spark, folder):
    cases = table(spark, folder, "phase1_bench").select(F.col("id").alias("case_id"))
    return evaluate.trust_report(cases, _found(spark, folder), table(spark, folder, "phase1_labels"))


@query(
    "o113_explain",
    f"""WITH named AS (SELECT DISTINCT id, ts, memory_id FROM (SELECT id, ts, unnest(json_extract_string(try_cast(payload_json AS JSON), '$.results[*].memoryId')) AS memory_id FROM {_AUDIT} WHERE try_cast(payload_json AS JSON) IS NOT NULL
  UNION ALL SELECT id, ts, json_extract_string(try_cast(payload_json AS JSON), '$.memoryId') FROM {_AUDIT} WHERE try_cast(payload_json AS JSON) IS NOT NULL) WHERE memory_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, id DESC) AS n FROM named),
a AS (SELECT memory_id, count(*) AS n_mentions, string_agg(CASE WHEN n <= 5 THEN id END, '|' ORDER BY n) AS recent_audit FROM r GROUP BY memory_id),
c AS (SELECT memory_id, count(*) AS n_chunks, min(line_start) AS first_line, max(line_end) AS last_line FROM chunks GROUP BY memory_id)
SELECT m.memory_id, m.status, coalesce(n_chunks, 0) AS n_chunks, first_line, last_line, coalesce(n_mentions, 0) AS n_mentions, coalesce(recent_audit, '') AS recent_audit FROM memories m LEFT JOIN c USING (memory_id) LEFT JOIN a USING (memory_id)""",
)
def o113(spark, folder):
    return evaluate.explained(table(spark, folder, "memories"), table(spark, folder, "chunks"), audit_log(spark, folder))


@query("o102_change_report", "SELECT c.source_path, count(*) AS seen, count(*) FILTER (m.memory_id IS NULL) AS changed FROM chunks c LEFT JOIN memories m ON m.memory_id = c.memory_id AND m.hash = c.hash GROUP BY c.source_path")
def o102(spark, folder):
    """How many records of each file were seen, and how many of them are not stored as such."""
    chunks = table(spark, folder, "chunks").select("source_path", "memory_id", "hash")
    per = lambda df, name: df.groupBy("source_path").agg(F.count(F.lit(1)).alias(name))
    fresh = store.changed(chunks, table(spark, folder, "memories"))
    return per(chunks, "seen").join(per(fresh, "changed"), "source_path", "left").select("source_path", "seen", F.coalesce("changed", F.lit(0)).alias("changed"))


@query("o102_index_report", "SELECT count(DISTINCT source_path) AS files_scanned, count(DISTINCT CASE WHEN m.memory_id IS NULL THEN source_path END) AS files_changed, count(*) AS sections, count(*) FILTER (m.memory_id IS NULL) AS changed, count(m.memory_id) AS unchanged FROM chunks c LEFT JOIN memories m ON m.memory_id = c.memory_id AND m.hash = c.hash")
def o102_report(spark, folder):
    return o102(spark, folder).agg(
        F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("changed") > 0).alias("files_changed"), F.sum("seen").alias("sections"),
        F.sum("changed").alias("changed"), F.sum(F.col("seen") - F.col("changed")).alias("unchanged"),
    )


@query(
    "o114_snippets",
    f"""WITH {_BM25}, asked AS (SELECT query_id, list_distinct(list(term)) AS terms FROM phrases GROUP BY query_id),
w AS (SELECT l.query_id, l.chunk_id, list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0) AS ws, terms FROM lex l JOIN chunks c USING (chunk_id) JOIN asked USING (query_id) WHERE l.rank <= 5),
h AS (SELECT *, list_transform(ws, lambda x: len(list_intersect({_TERMS('x')}, terms)) > 0) AS hits FROM w),
s AS (SELECT *, greatest(1, least(greatest(coalesce(list_position(hits, true), 1), 1) - 4, len(ws) - 7)) AS a FROM h)
SELECT query_id, chunk_id, CASE WHEN a > 1 THEN '...' ELSE '' END || array_to_string(list_transform(list_slice(list_zip(ws, hits), a, a + 7), lambda z: CASE WHEN z[2] THEN '[' || z[1] || ']' ELSE z[1] END), ' ') || CASE WHEN a + 8 <= len(ws) THEN '...' ELSE '' END AS snippet FROM s""",
)
def o114(spark, folder):
    """Where the five best chunks of each question say what it asks for."""
    found = _lexical(spark, folder).where("rank <= 5").join(table(spark, folder, "chunks").select("chunk_id", "text").hint("merge"), "chunk_id")
    return snippets(found, _bench(spark, folder))
