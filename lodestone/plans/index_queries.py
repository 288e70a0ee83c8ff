"""Registered queries on identity, text functions, segmentation, store and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators import evaluate, segment, store
from lodestone.plans.ingest import extract_memories, hint_of
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The fixed "now" of queries that look back in time.
NOW = "2026-07-01 00:00:00"

_SP = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = lambda c: rf"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
_CANON = _TRIM(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


@query("o20_sha256", "SELECT chunk_id, sha256(text) AS digest FROM chunks")
def o20(spark, folder):
    return _chunks(spark, folder).select("chunk_id", F.sha2("text", 256).alias("digest"))


@query("o21_canonical", f"SELECT chunk_id, {_CANON} AS canonical FROM chunks")
def o21(spark, folder):
    return _chunks(spark, folder).select("chunk_id", X.canonical(F.col("text")).alias("canonical"))


@query("o22_content_hash", f"SELECT chunk_id, sha256({_CANON}) AS content_hash FROM chunks")
def o22(spark, folder):
    return _chunks(spark, folder).select("chunk_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("o23_memory_id", "SELECT memory_id AS source_id, 'mem_' || substr(sha256(coalesce(memory_type,'') || chr(0) || coalesce(channel,'') || chr(0) || coalesce(project,'') || chr(0) || coalesce(hash,'')), 1, 24) AS new_id FROM memories")
def o23(spark, folder):
    m = table(spark, folder, "memories")
    return m.select(F.col("memory_id").alias("source_id"), X.hashed_id("mem_", F.col("memory_type"), F.col("channel"), F.col("project"), F.col("hash")).alias("new_id"))


@query("o24_chunk_id", "SELECT chunk_id AS source_id, 'chk_' || substr(sha256(coalesce(memory_id,'') || chr(0) || coalesce(line_start::VARCHAR,'') || chr(0) || coalesce(hash,'')), 1, 24) AS new_id FROM chunks")
def o24(spark, folder):
    return _chunks(spark, folder).select(F.col("chunk_id").alias("source_id"), X.hashed_id("chk_", F.col("memory_id"), F.col("line_start"), F.col("hash")).alias("new_id"))


@query("o25_summary", rf"SELECT chunk_id, coalesce(left(regexp_replace(regexp_replace({_TRIM('x')}, '^[-*+]\s+', ''), '^\d+\.\s+', ''), 200), '(empty section)') AS summary FROM (SELECT chunk_id, list_filter(string_split_regex(text, '\r?\n'), lambda l: NOT regexp_matches(l, '^(#{{1,6}})\s+(.+?)\s*#*\s*$') AND length({_TRIM('l')}) > 0)[1] AS x FROM chunks)")
def o25(spark, folder):
    return _chunks(spark, folder).select("chunk_id", X.summary(F.col("text")).alias("summary"))


_DATE = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
_BUILD = lambda c: f"CASE WHEN regexp_matches({c}, '{_DATE}') THEN regexp_extract({c}, '{_DATE}', 1) || '-' || lpad(regexp_extract({c}, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract({c}, '{_DATE}', 3), 2, '0') || 'T00:00:00.000Z' END"


@query("o27_first_date", f"SELECT memory_id, coalesce({_BUILD('timestamp')}, {_BUILD('json')}, 'none') AS dated FROM memories")
def o27(spark, folder):
    return table(spark, folder, "memories").select("memory_id", X.first_date(F.col("timestamp"), F.col("json"), F.lit("none")).alias("dated"))


#: The score in SQL, with its patterns written out.
_IMPORTANCE = r"""floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE
 + CASE WHEN regexp_matches(text, '(?i)\bdecided\b|\bwe (will|should|chose|picked|use)\b|\bgo with\b|\bfrom now on\b|决定|拍板|选定|以后默认|今后|统一约定') THEN 0.2::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN regexp_matches(text, '(?i)\bremember (this|that)\b|\bdon''t forget\b|记住|记下|记一下|写入记忆') THEN 0.25::DOUBLE ELSE 0::DOUBLE END
 + least(0.15::DOUBLE, 0.05::DOUBLE * (regexp_matches(text, '(?i)content[- ]adapter')::INT + regexp_matches(text, '(?i)flutter')::INT + regexp_matches(text, '(?i)docker')::INT + regexp_matches(text, '(?i)wsl')::INT))
 + CASE WHEN regexp_matches(text, '\b(19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b') THEN 0.05::DOUBLE ELSE 0::DOUBLE END
 - CASE WHEN length(text) < 80 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)) * 1000 + 0.5) / 1000"""


@query("o28_importance", f"SELECT chunk_id, {_IMPORTANCE} AS importance FROM chunks")
def o28(spark, folder):
    return _chunks(spark, folder).select("chunk_id", X.importance(F.col("text")).alias("importance"))


@query(
    "o28_signals",
    r"""SELECT chunk_id, array_to_string(list_filter(['baseline:0.40',
 CASE WHEN regexp_matches(text, '(?i)\bdecided\b|\bwe (will|should|chose|picked|use)\b|\bgo with\b|\bfrom now on\b|决定|拍板|选定|以后默认|今后|统一约定') THEN 'decision:+0.20' END,
 CASE WHEN regexp_matches(text, '(?i)\bremember (this|that)\b|\bdon''t forget\b|记住|记下|记一下|写入记忆') THEN 'remember:+0.25' END,
 CASE WHEN n > 0 THEN 'entities(' || n || '):+' || CASE n WHEN 1 THEN '0.05' WHEN 2 THEN '0.10' ELSE '0.15' END END,
 CASE WHEN regexp_matches(text, '\b(19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b') THEN 'timestamp:+0.05' END,
 CASE WHEN length(text) < 80 THEN 'too_short:-0.20' END], lambda x: x IS NOT NULL), '|') AS signals
FROM (SELECT *, regexp_matches(text, '(?i)content[- ]adapter')::INT + regexp_matches(text, '(?i)flutter')::INT + regexp_matches(text, '(?i)docker')::INT + regexp_matches(text, '(?i)wsl')::INT AS n FROM chunks)""",
)
def o28_signals(spark, folder):
    return _chunks(spark, folder).select("chunk_id", F.array_join(X.importance_signals(F.col("text")), "|").alias("signals"))


@query("o29_query_tokens", "SELECT id, unnest(list_filter(string_split_regex(query, '[\\s,.;:!?()''\"`，。；：！？（）]+'), lambda t: length(t) >= 2)) AS token FROM phase1_bench")
def o29(spark, folder):
    return table(spark, folder, "phase1_bench").select("id", F.explode(X.query_tokens(F.col("query"))).alias("token"))


@query("o30_payload", "SELECT id, ts, kind, CASE WHEN try_cast(payload_json AS JSON) IS NOT NULL THEN json_extract_string(payload_json, '$.query') END AS query, try_cast(payload_json AS JSON) IS NULL AS broken FROM audit")
def o30(spark, folder):
    a = table(spark, folder, "audit")
    ok = F.try_parse_json("payload_json").isNotNull()
    return a.select("id", "ts", "kind", F.when(ok, F.get_json_object("payload_json", "$.query")).alias("query"), (~ok).alias("broken"))


@query("o30b_citation", "SELECT chunk_id, CASE WHEN line_start IS NOT NULL AND line_end IS NOT NULL THEN source_path || '#L' || line_start || '-L' || line_end ELSE source_path END AS citation FROM chunks")
def o30b(spark, folder):
    return _chunks(spark, folder).select("chunk_id", X.citation(F.col("source_path"), F.col("line_start"), F.col("line_end")).alias("citation"))


_HEAD = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
_LINES = "SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS n FROM documents"


@query("o40_lines", f"SELECT doc_id, n::INT AS n, line FROM ({_LINES})")
def o40(spark, folder):
    return segment.lines(table(spark, folder, "documents"), "doc_id")


@query("o41_headings", f"SELECT doc_id, n::INT AS n, length(regexp_extract(line, '{_HEAD}', 1))::INT AS level, regexp_extract(line, '{_HEAD}', 2) AS title FROM ({_LINES}) WHERE regexp_matches(line, '{_HEAD}')")
def o41(spark, folder):
    return segment.headings(table(spark, folder, "documents"), "doc_id")


_H2, _H1 = r"^##\s+(.+?)\s*#*\s*$", r"^#\s+(.+?)\s*#*\s*$"
_SECTION_SQL = f"""
WITH l AS ({_LINES}),
s AS (SELECT *, sum(regexp_matches(line, '{_H2}')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l),
t AS (SELECT doc_id, g, min(n)::INT AS line_start, max(n)::INT AS line_end, string_agg(line, chr(10) ORDER BY n) AS text, first(line ORDER BY n) AS head FROM s GROUP BY doc_id, g),
k AS (SELECT * FROM t WHERE length({_TRIM('text')}) > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS section,
  CASE WHEN regexp_matches(head, '{_H2}') THEN regexp_extract(head, '{_H2}', 1) WHEN line_start = 1 AND regexp_matches(head, '{_H1}') THEN regexp_extract(head, '{_H1}', 1) ELSE '(top)' END AS title,
  line_start, line_end, text FROM k"""


@query("o42_sections", _SECTION_SQL)
def o42(spark, folder):
    return segment.sections(table(spark, folder, "documents"), "doc_id")


_PARA_SQL = f"""
WITH l AS ({_LINES}), b AS (SELECT *, length({_TRIM('line')}) = 0 AS blank FROM l),
g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM b),
p AS (SELECT doc_id, grp, min(n)::INT AS line_start, max(n)::INT AS line_end, {_TRIM("string_agg(line, chr(10) ORDER BY n)")} AS text FROM g WHERE NOT blank GROUP BY doc_id, grp)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS paragraph, line_start, line_end, text FROM p"""


@query("o45_paragraphs", _PARA_SQL)
def o45(spark, folder):
    return segment.paragraphs(table(spark, folder, "documents"), "doc_id")


@query("o46_packed", f"""
WITH RECURSIVE q AS ({_PARA_SQL.replace('WITH l', 'WITH l', 1)}),
r AS (SELECT doc_id, paragraph, line_start, line_end, text, length(text) + 2 AS size, 0 AS chunk, length(text) >= 900 AS own FROM q WHERE paragraph = 0
 UNION ALL SELECT q.doc_id, q.paragraph, q.line_start, q.line_end, q.text,
  CASE WHEN NOT r.own AND length(q.text) < 900 AND r.size + length(q.text) + 2 <= 900 THEN r.size + length(q.text) + 2 ELSE length(q.text) + 2 END,
  CASE WHEN NOT r.own AND length(q.text) < 900 AND r.size + length(q.text) + 2 <= 900 THEN r.chunk ELSE r.chunk + 1 END,
  CASE WHEN NOT r.own AND length(q.text) < 900 AND r.size + length(q.text) + 2 <= 900 THEN false ELSE length(q.text) >= 900 END
 FROM r JOIN q ON q.doc_id = r.doc_id AND q.paragraph = r.paragraph + 1)
SELECT doc_id, chunk::INT AS chunk, min(line_start)::INT AS line_start, max(line_end)::INT AS line_end, length(string_agg(text, chr(10) || chr(10) ORDER BY paragraph))::INT AS n_chars FROM r GROUP BY doc_id, chunk""")
def o46(spark, folder):
    return segment.pack_paragraphs(table(spark, folder, "documents"), "doc_id").drop("text")


_ITEM = r"^ {0,3}(?:[-*+]|\d+\.)\s+"


@query("o47_lists_split", f"""
WITH RECURSIVE q AS ({_PARA_SQL.replace('WITH l', 'WITH l', 1)}),
it AS (SELECT doc_id, paragraph, line_start AS base, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM q WHERE length(text) >= 900),
ig AS (SELECT *, sum((ln = 1 OR regexp_matches(line, '{_ITEM}'))::INT) OVER (PARTITION BY doc_id, paragraph ORDER BY ln) AS g FROM it),
gr AS (SELECT doc_id, paragraph, g, base, min(ln) AS a, max(ln) AS z, string_agg(line, chr(10) ORDER BY ln) AS text FROM ig GROUP BY doc_id, paragraph, g, base),
gp AS (SELECT doc_id, paragraph, g, base, a, z, text, 0 AS piece, length(text) AS size FROM gr WHERE g = 1
 UNION ALL SELECT gr.doc_id, gr.paragraph, gr.g, gr.base, gr.a, gr.z, gr.text, CASE WHEN gp.size + 1 + length(gr.text) <= 900 THEN gp.piece ELSE gp.piece + 1 END, CASE WHEN gp.size + 1 + length(gr.text) <= 900 THEN gp.size + 1 + length(gr.text) ELSE length(gr.text) END
 FROM gp JOIN gr ON gr.doc_id = gp.doc_id AND gr.paragraph = gp.paragraph AND gr.g = gp.g + 1),
pt AS (SELECT doc_id, paragraph, 0 AS piece, line_start, line_end, length(text) AS len, false AS own FROM q WHERE length(text) < 900
 UNION ALL SELECT doc_id, paragraph, piece, min(base + a - 1), max(base + z - 1), length(string_agg(text, chr(10) ORDER BY g)), true FROM gp GROUP BY doc_id, paragraph, piece),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, piece) AS i FROM pt),
r AS (SELECT doc_id, i, line_start, line_end, len + 2 AS size, 0 AS chunk, own FROM p WHERE i = 1
 UNION ALL SELECT p.doc_id, p.i, p.line_start, p.line_end,
  CASE WHEN NOT r.own AND NOT p.own AND r.size + p.len + 2 <= 900 THEN r.size + p.len + 2 ELSE p.len + 2 END,
  CASE WHEN NOT r.own AND NOT p.own AND r.size + p.len + 2 <= 900 THEN r.chunk ELSE r.chunk + 1 END,
  p.own FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, chunk::INT AS chunk, min(line_start)::INT AS line_start, max(line_end)::INT AS line_end, (sum(p.len) + 2 * (count(*) - 1))::INT AS n_chars FROM r JOIN p USING (doc_id, i, line_start, line_end) GROUP BY doc_id, chunk""")
def o47(spark, folder):
    """Packing with paragraphs as long as the target cut at their list items."""
    return segment.pack_paragraphs(table(spark, folder, "documents"), "doc_id", split_lists=True).drop("text")


@query("o48_overlap", ORACLES["o46_packed"].rpartition("SELECT doc_id, chunk::INT")[0].rstrip() + """,
c AS (SELECT doc_id, chunk, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM r GROUP BY doc_id, chunk),
o AS (SELECT doc_id, chunk, text FROM c WHERE chunk = 0
 UNION ALL SELECT c.doc_id, c.chunk, """ + _TRIM("right(o.text, 150)") + """ || chr(10) || chr(10) || c.text FROM o JOIN c ON c.doc_id = o.doc_id AND c.chunk = o.chunk + 1)
SELECT doc_id, chunk::INT AS chunk, length(text)::INT AS n_chars, sha256(text) AS digest FROM o""")
def o48(spark, folder):
    packed = segment.pack_paragraphs(table(spark, folder, "documents"), "doc_id")
    gathered = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("cs"))
    each = gathered.select("doc_id", F.posexplode(segment.with_overlap(F.transform("cs", lambda c: c["text"]))).alias("chunk", "text"))
    return each.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


_OWN = f"SELECT doc_id, n, length(regexp_extract(line, '{_HEAD}', 1)) AS level, regexp_extract(line, '{_HEAD}', 2) AS title FROM ({_LINES}) WHERE regexp_matches(line, '{_HEAD}')"


@query("o44_heading_paths", f"WITH h AS ({_OWN}) SELECT h.doc_id, h.n::INT AS n, h.level::INT AS level, string_agg(a.title, ' > ' ORDER BY a.n) AS path FROM h JOIN h a ON a.doc_id = h.doc_id AND a.n <= h.n AND (a.n = h.n OR (a.level < h.level AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.n > a.n AND b.n <= h.n AND b.level <= a.level))) GROUP BY ALL")
def o44(spark, folder):
    return segment.heading_paths(table(spark, folder, "documents"), "doc_id")


@query(
    "o13_upserted",
    f"""SELECT memory_id, status, created_at, updated_at FROM memories WHERE source_kind <> 'compiled'
UNION ALL SELECT memory_id, 'superseded', created_at, TIMESTAMPTZ '{NOW}+00' FROM memories WHERE source_kind = 'compiled' AND status = 'active'
UNION ALL SELECT memory_id, status, created_at, updated_at FROM memories WHERE source_kind = 'compiled' AND status <> 'active'
UNION ALL SELECT 'new_' || chunk_id, 'active', TIMESTAMPTZ '{NOW}+00', TIMESTAMPTZ '{NOW}+00' FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories)""",
)
def o13(spark, folder):
    """Compiled memories come again with another status, and chunks without a memory bring new ones."""
    current = table(spark, folder, "memories").select("memory_id", "source_kind", "status", "created_at", "updated_at")
    now = F.lit(f"{NOW}+00:00").cast("timestamp")
    again = current.where("source_kind = 'compiled' and status = 'active'").select("memory_id", "source_kind", F.lit("superseded").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    lost = _chunks(spark, folder).join(current, "memory_id", "left_anti")
    new = lost.select(F.concat(F.lit("new_"), "chunk_id").alias("memory_id"), F.lit("human_confirmed").alias("source_kind"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    return store.upsert(current, again.unionByName(new), "memory_id").drop("source_kind")


@query("o15_status", "SELECT memory_id, CASE WHEN memory_id IN (SELECT memory_id FROM (SELECT memory_id FROM memories WHERE importance >= 0.5 ORDER BY memory_id LIMIT 20)) THEN 'archived' ELSE status END AS status FROM memories")
def o15(spark, folder):
    """A status set for a stated list of ids (here the first 20 important memories)."""
    memories = table(spark, folder, "memories").select("memory_id", "status", "importance")
    ids = [r["memory_id"] for r in memories.where("importance >= 0.5").orderBy("memory_id").limit(20).collect()]
    return store.set_status(memories.drop("importance"), ids, "archived")


@query("o33_changed", "SELECT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.memory_id = c.memory_id AND m.hash = c.hash)")
def o33(spark, folder):
    return store.changed(_chunks(spark, folder).select("chunk_id", "memory_id", "hash"), table(spark, folder, "memories")).select("chunk_id")


_HINTED = "try_cast(json AS JSON)"


@query(
    "o26_hint",
    f"""SELECT memory_id, json_extract_string({_HINTED}, '$.memoryId') AS hinted_id, json_extract_string({_HINTED}, '$.memoryType') AS hinted_type,
 json_extract_string({_HINTED}, '$.provenance.sourceKind') AS hinted_kind, array_to_string(json_extract_string({_HINTED}, '$.tags[*]'), ',') AS tags
FROM memories WHERE {_HINTED} IS NOT NULL AND json_extract_string({_HINTED}, '$.memoryType') IN ('episode', 'fact', 'decision', 'preference', 'procedure', 'summary')
 AND json_extract_string({_HINTED}, '$.provenance.sourceKind') IN ('human_confirmed', 'tool_observed', 'compiled', 'assistant_inferred')""",
)
def o26(spark, folder):
    """Each memory's record, fenced as a hint in a text, and read back; broken records are no hints."""
    memories = table(spark, folder, "memories").select("memory_id", F.concat(F.lit("## A\n```memory\n"), "json", F.lit("\n```\nrest")).alias("text"))
    read = memories.select("memory_id", hint_of(F.col("text")).alias("h")).where("h is not null")
    return read.select("memory_id", F.col("h.memoryId").alias("hinted_id"), F.col("h.memoryType").alias("hinted_type"), F.col("h.sourceKind").alias("hinted_kind"), F.array_join(F.coalesce("h.tags", F.array().cast("array<string>")), ",").alias("tags"))


_MADE = f"""SELECT *, 'mem_' || substr(sha256('episode' || chr(0) || doc_id || chr(0) || title || chr(0) || sha256({_CANON})), 1, 24) AS memory_id, {_IMPORTANCE} AS importance,
 coalesce({_BUILD('title')}, {_BUILD('text')}, '{NOW}') AS timestamp FROM (SELECT doc_id::VARCHAR AS doc_id, * EXCLUDE (doc_id) FROM ({_SECTION_SQL}))"""


@query("o43_memories", f"SELECT memory_id, min(doc_id) AS path, min(title) AS title, min(importance) AS importance, min(timestamp) AS timestamp, min(line_start)::INT AS line_start, min_by(line_end, line_start)::INT AS line_end, 1.0::DOUBLE AS confidence, 'human_confirmed' AS source_kind FROM ({_MADE}) GROUP BY memory_id")
def o43(spark, folder):
    """The records of all sections of all documents."""
    files = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    made = extract_memories(files, NOW)
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return made.select("memory_id", "path", field("title").alias("title"), "importance", "timestamp", "line_start", field("line_end").cast("int").alias("line_end"), "confidence", "source_kind")


@query(
    "o49_absolute_lines",
    f"""WITH l AS ({_LINES}), b AS (SELECT *, length({_TRIM('line')}) = 0 AS blank, sum(regexp_matches(line, '{_H2}')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM b)
SELECT doc_id, min(n)::INT AS line_start, max(n)::INT AS line_end, length({_TRIM("string_agg(line, chr(10) ORDER BY n)")})::INT AS n_chars FROM g WHERE NOT blank GROUP BY doc_id, sec, grp""",
)
def o49(spark, folder):
    """The lines in their document of the paragraphs of all sections."""
    sections = segment.sections(table(spark, folder, "documents"), "doc_id").select(F.struct("doc_id", F.col("line_start").alias("base")).alias("at"), "text")
    inside = segment.paragraphs(sections, "at")
    line = lambda c: segment.absolute_line(F.col("at.base"), F.col(c)).alias(c)
    return inside.select("at.doc_id", line("line_start"), line("line_end"), F.length("text").alias("n_chars"))


@query("o31_resolved", "SELECT c.chunk_id, CASE WHEN m.memory_id IS NULL THEN 'missing_memory_row' ELSE 'ok' END AS outcome FROM chunks c LEFT JOIN memories m ON m.memory_id = c.memory_id")
def o31(spark, folder):
    m = table(spark, folder, "memories").select("memory_id", F.lit("ok").alias("outcome"))
    return _chunks(spark, folder).select("chunk_id", "memory_id").join(m, "memory_id", "left").select("chunk_id", F.coalesce("outcome", F.lit("missing_memory_row")).alias("outcome"))


@query("o90_counts", "SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM chunks) AS chunks")
def o90(spark, folder):
    return table(spark, folder, "memories").agg(F.count(F.lit(1)).alias("memories")).crossJoin(_chunks(spark, folder).agg(F.count(F.lit(1)).alias("chunks")))


def _grouped(name, source, *by):
    @query(name, f"SELECT {', '.join(by)}, count(*) AS n FROM {source} GROUP BY ALL")
    def run(spark, folder):
        return table(spark, folder, source).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


_grouped("o91_by_status", "memories", "status")
_grouped("o92_by_source_kind", "memories", "source_kind")
_grouped("o94_models", "chunks", "embedding_model_id")


@query("o93_indexed_memories", "SELECT DISTINCT memory_id FROM chunks")
def o93(spark, folder):
    return _chunks(spark, folder).select("memory_id").distinct()


@query("o09_chunk_order", "SELECT memory_id, chunk_id, row_number() OVER (PARTITION BY memory_id ORDER BY chunk_id)::INT AS position FROM chunks")
def o09(spark, folder):
    return _chunks(spark, folder).select("memory_id", "chunk_id", F.row_number().over(Window.partitionBy("memory_id").orderBy("chunk_id")).alias("position"))


_AUDIT = "(SELECT id, min(ts) AS ts, min(kind) AS kind, max(payload_json) AS payload_json FROM audit GROUP BY id)"


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The audit log with redelivered records once (map-side combined)."""
    return table(spark, folder, "audit").groupBy("id").agg(F.min("ts").alias("ts"), F.min("kind").alias("kind"), F.max("payload_json").alias("payload_json"))


@query("o38_audit_mentions", f"SELECT a.id, r.memory_id FROM {_AUDIT} a, (SELECT unnest(json_extract_string(payload_json, '$.results[*].memoryId')) AS memory_id, id FROM {_AUDIT} WHERE try_cast(payload_json AS JSON) IS NOT NULL) r WHERE a.id = r.id GROUP BY ALL")
def o38(spark, folder):
    results = F.from_json("payload_json", "struct<results:array<struct<memoryId:string>>>")["results"]["memoryId"]
    ok = audit_log(spark, folder).where(F.try_parse_json("payload_json").isNotNull())
    return ok.select("id", F.explode(results).alias("memory_id")).where("memory_id is not null").distinct()


@query("o103_index_age", f"SELECT max(ts) AS last_rebuild, round((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(max(ts))) / 1e6)::BIGINT AS age_seconds, CASE WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(max(ts)) < 24 * 3600500000 THEN 'ok' ELSE 'warn' END AS status FROM {_AUDIT} WHERE kind = 'rebuild'")
def o103(spark, folder):
    return evaluate.index_age(audit_log(spark, folder), F.lit(f"{NOW}+00:00").cast("timestamp"))


#: A moment within the time of the audit log.
_WITHIN = "2026-06-01 00:00:00"
_RATE = lambda hours: f"SELECT {hours} AS hours, count(*) AS retrievals, count(*) FILTER (n = 0) AS empty, floor(count(*) FILTER (n = 0)::DOUBLE / nullif(count(*), 0) * 1000 + 0.5) / 1000 AS rate, CASE WHEN count(*) FILTER (n = 0)::DOUBLE / nullif(count(*), 0) > 0.3 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT CASE WHEN try_cast(payload_json AS JSON) IS NULL THEN 0 ELSE coalesce(json_array_length(payload_json, '$.results'), 0) END AS n FROM {_AUDIT} WHERE kind = 'retrieve' AND epoch_us(ts) >= epoch_us(TIMESTAMPTZ '{_WITHIN}+00') - {hours} * 3600000000)"


@query("o105_zero_results", f"{_RATE(24)} UNION ALL {_RATE(8760)}")
def o105(spark, folder):
    """Retrievals without results within a day and within a year."""
    audit, now = audit_log(spark, folder), F.lit(f"{_WITHIN}+00:00").cast("timestamp")
    rate = lambda hours: evaluate.zero_results(audit, now, hours).select(F.lit(hours).alias("hours"), "*")
    return rate(24).unionByName(rate(8760))


@query("o106_chunk_sizes", "SELECT round(avg(length(text)) / 4, 6) AS avg_tokens, min(length(text)) AS shortest, max(length(text)) AS longest FROM chunks")
def o106(spark, folder):
    n = F.length("text")
    return _chunks(spark, folder).agg(F.round(F.avg(n) / 4, 6).alias("avg_tokens"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@query("o107_retired", "SELECT count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (source_kind = 'assistant_inferred') AS inferred FROM memories")
def o107(spark, folder):
    return table(spark, folder, "memories").agg(F.count_if(F.col("status") == "archived").alias("archived"), F.count_if(F.col("source_kind") == "assistant_inferred").alias("inferred"))


@query("o110_recent_audit", f"SELECT id, ts FROM {_AUDIT} WHERE kind = 'health' ORDER BY ts DESC, id DESC LIMIT 20")
def o110(spark, folder):
    return audit_log(spark, folder).where("kind = 'health'").orderBy(F.desc("ts"), F.desc("id")).limit(20).select("id", "ts")


@query("o111_audit_since", f"SELECT id, ts, kind FROM {_AUDIT} WHERE ts >= TIMESTAMPTZ '2026-01-01 00:00:00+00'")
def o111(spark, folder):
    return audit_log(spark, folder).where("ts >= timestamp '2026-01-01 00:00:00Z'").select("id", "ts", "kind")


@query("o112_latest_of_kind", f"SELECT kind, max_by(id, (ts, id)) AS id, max(ts) AS ts FROM {_AUDIT} GROUP BY kind")
def o112(spark, folder):
    return audit_log(spark, folder).groupBy("kind").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))
