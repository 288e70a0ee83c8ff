"""From files to the published index: sections, records, chunks, vectors, postings; change detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import segment
from lodestone.operators.lexical import lengths_of, postings_of, tokenised
from lodestone.operators.store import Store, changed, upsert
from lodestone.operators.vector import stub_vector
from lodestone.session import cut

#: What the fields of a record may say.
MEMORY_TYPES = ("episode", "fact", "decision", "preference", "procedure", "summary")
STATUSES = ("active", "superseded", "archived")
SCOPES = ("global", "project", "channel", "private")
SOURCE_KINDS = ("human_confirmed", "tool_observed", "compiled", "assistant_inferred")

_HINT_TEXT = ("memoryId", "timestamp", "project", "channel")
_HINT_CHOICE = {"memoryType": MEMORY_TYPES, "status": STATUSES, "scope": SCOPES}
_HINT_NUMBER = ("importance", "confidence")
_HINT_LIST = ("tags", "entities")


def hint_of(text: Column) -> Column:
    """The first block fenced as ``memory``, as ``struct`` of its known fields; null where there is none.

    One field of a wrong type or with a value that it can't have, or broken JSON,
    voids the whole hint; unknown fields are left aside.  Fields: the texts and
    numbers, ``tags`` and ``entities`` as arrays, ``sourceKind`` from ``provenance``.
    """
    block = F.regexp_extract(text, r"(?s)```memory\s*\n(.*?)\n```", 1)
    parsed = F.try_parse_json(F.when(block != "", block))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, f"$.{path}", "variant"))
    said = lambda path: F.try_variant_get(parsed, f"$.{path}", "string")
    whole = r"^BIGINT|^DECIMAL\(\d+,0\)"
    holds = lambda path, test: F.coalesce(test, kind(path).isNull())
    ok = parsed.isNotNull() & kind_is(parsed, "OBJECT")
    for name in _HINT_TEXT:
        ok = ok & holds(name, kind(name) == "STRING")
    for name, values in _HINT_CHOICE.items():
        ok = ok & holds(name, (kind(name) == "STRING") & said(name).isin(*values))
    for name in _HINT_NUMBER:
        ok = ok & holds(name, kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE)") & F.try_variant_get(parsed, f"$.{name}", "double").between(0, 1))
    for name in _HINT_LIST:
        ok = ok & holds(name, kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>"))
    ok = ok & holds("schemaVersion", kind("schemaVersion").rlike(whole) & (said("schemaVersion") == "1"))
    ok = ok & holds("provenance", kind("provenance").startswith("OBJECT"))
    ok = ok & holds("provenance.path", (kind("provenance.path") == "STRING") & (F.length(said("provenance.path")) > 0))
    ok = ok & holds("provenance.sourceKind", (kind("provenance.sourceKind") == "STRING") & said("provenance.sourceKind").isin(*SOURCE_KINDS))
    for name in ("provenance.lineStart", "provenance.lineEnd"):
        ok = ok & holds(name, kind(name).rlike(whole) & (F.try_variant_get(parsed, f"$.{name}", "double") > 0))
    fields = [said(n).alias(n) for n in (*_HINT_TEXT, *_HINT_CHOICE)] + [F.try_variant_get(parsed, f"$.{n}", "double").alias(n) for n in _HINT_NUMBER]
    fields += [F.try_variant_get(parsed, f"$.{n}", "array<string>").alias(n) for n in _HINT_LIST] + [said("provenance.sourceKind").alias("sourceKind")]
    return F.when(F.contains(text, F.lit("```memory")), F.when(ok, F.struct(*fields)))


def kind_is(variant: Column, kind: str) -> Column:
    return F.schema_of_variant(variant).startswith(kind)


def extract_memories(files: DataFrame, now: str, source_kind: str = "human_confirmed", scope: str = "global", project: str | None = None, channel: str | None = None) -> DataFrame:
    """One record for each section of ``files`` (``path, text``), with its text and lines.

    What a section's hint says holds, else the defaults given here.  The id of a
    section without a hinted one depends on path, title and text, so that a section
    put in elsewhere in the file leaves it as it is; sections that are equal in all
    three are one record, the first of them.
    """
    parts = segment.sections(files, "path").withColumn("hint", hint_of(F.col("text")))
    said = lambda name, default: F.coalesce(F.col(f"hint.{name}"), default)
    hashed = X.content_hash(F.col("text"))
    listed = lambda name: said(name, F.array().cast("array<string>"))
    kind = said("sourceKind", F.lit(source_kind))
    record = F.to_json(
        F.struct(
            F.col("title"), X.summary(F.col("text")).alias("summary"), listed("tags").alias("tags"), listed("entities").alias("entities"), F.array(F.lit("user"), F.lit("assistant")).alias("participants"),
            F.col("path"), F.col("line_start"), F.col("line_end"), F.struct(F.col("path"), F.col("line_start").alias("lineStart"), F.col("line_end").alias("lineEnd"), kind.alias("sourceKind")).alias("provenance"),
        )
    )
    each = parts.select(
        said("memoryId", X.hashed_id("mem_", F.lit("episode"), F.col("path"), F.col("title"), hashed)).alias("memory_id"),
        F.lit("episode").alias("memory_type"), F.lit(1).alias("schema_version"),
        said("timestamp", X.first_date(F.col("title"), F.col("text"), F.lit(now))).alias("timestamp"),
        said("importance", X.importance(F.col("text"))).alias("importance"), said("confidence", F.lit(1.0)).alias("confidence"), said("status", F.lit("active")).alias("status"),
        kind.alias("source_kind"), said("scope", F.lit(scope)).alias("scope"), said("project", F.lit(project).cast("string")).alias("project"), said("channel", F.lit(channel).cast("string")).alias("channel"),
        hashed.alias("hash"), record.alias("json"),
        F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), "path", "line_start", "text",
    )
    first = each.groupBy("memory_id").agg(F.min_by(F.struct(*[c for c in each.columns if c != "memory_id"]), F.struct("path", "line_start")).alias("r"))
    return first.select("memory_id", "r.*")


def chunk_memories(memories: DataFrame, model_id: str, now: str, target: int = 900, overlap: int = 150) -> DataFrame:
    """Chunks of records with absolute lines and soft overlap."""
    packed = segment.pack_paragraphs(memories, "memory_id", "text", target, split_lists=True)
    gathered = packed.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "line_start", "line_end", "text"))).alias("cs"))
    spread = gathered.withColumn("ts", segment.with_overlap(F.transform("cs", lambda c: c["text"]), overlap)).select("memory_id", F.posexplode(F.arrays_zip("cs", "ts")).alias("i", "z"))
    full = spread.hint("merge").join(memories.select("memory_id", "path", F.col("line_start").alias("base")).hint("merge"), "memory_id")  # texts are never broadcast
    hashed = X.content_hash(F.col("z.ts"))
    return full.select(
        X.hashed_id("chk_", F.col("memory_id"), F.col("i"), hashed).alias("chunk_id"), "memory_id", F.col("z.ts").alias("text"), F.col("path").alias("source_path"),
        segment.absolute_line(F.col("base"), F.col("z.cs.line_start")).alias("line_start"), segment.absolute_line(F.col("base"), F.col("z.cs.line_end")).alias("line_end"),
        F.lit(model_id).alias("embedding_model_id"), hashed.alias("hash"), F.lit(now).cast("timestamp").alias("created_at"),
    )


def index_files(store: Store, files: DataFrame, now: str, whole_tree: bool = True, paths: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, **defaults) -> dict[str, int]:
    """Bring the index up to date with ``files``; returns counts.

    Unchanged sections are neither chunked nor embedded again.  With ``whole_tree``
    sections that are gone are archived; without it (a micro-batch of edited files)
    only those of the files at hand, or of ``paths``, which also names files that were
    removed.  ``embed`` turns texts into vectors (without it the stub of the store's
    dimension); ``defaults`` go to ``extract_memories``.

    Only buckets that hold a changed or archived memory are read and written again.
    """
    meta = store.meta()
    embed = embed or (lambda c: stub_vector(c, int(meta["embedding_dim"])))
    seen = cut(extract_memories(files, now, **defaults))
    current = store.read("memories")
    fresh = cut(changed(seen, current))
    scope = current.where("status <> 'archived'")
    if not whole_tree:
        touched_paths = (seen if paths is None else paths).select(F.col("path").alias("_path")).distinct()
        scope = scope.join(touched_paths, F.get_json_object("json", "$.path") == F.col("_path"), "left_semi")
    gone = cut(scope.join(seen.select("memory_id"), "memory_id", "left_anti").select("memory_id"))
    counts = {
        "files_scanned": files.select("path").distinct().count(), "files_changed": fresh.select("path").distinct().count(),
        "sections": seen.count(), "changed": fresh.count(), "archived": gone.count(), "chunks": 0, "embedded": 0,
    }
    counts["unchanged"] = counts["sections"] - counts["changed"]
    places = fresh.select("memory_id").unionByName(gone).select(store.bucket(F.col("memory_id")).alias("b")).distinct()
    buckets = sorted(r["b"] for r in places.collect())  # at most one row for each bucket
    if buckets:
        old = {name: store.read(name, buckets) for name in ("memories", "chunks", "vectors", "postings", "lengths")}
        memories = upsert(old["memories"], fresh.select(old["memories"].columns), "memory_id")
        retired = memories.join(gone.withColumn("_gone", F.lit(True)), "memory_id", "left")
        memories = retired.withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).select(old["memories"].columns)
        chunks = cut(chunk_memories(fresh, meta["embedding_model_id"], now))
        added = cut(chunks.join(old["chunks"].select("chunk_id"), "chunk_id", "left_anti"))
        tokens = tokenised(added)
        keyed = lambda df: df.join(added.select("chunk_id", "memory_id"), "chunk_id")
        new = {
            "vectors": added.select("chunk_id", "memory_id", embed(F.col("text")).cast("array<float>").alias("vector")),
            "postings": keyed(postings_of(tokens)),
            "lengths": keyed(lengths_of(tokens)),
        }
        tables = {name: old[name].unionByName(df.select(old[name].columns)) for name, df in new.items()}
        store.publish({"memories": memories, "chunks": upsert(old["chunks"], chunks, "chunk_id")} | tables, buckets)
        counts["chunks"], counts["embedded"] = chunks.count(), added.count()
    store.append_audit("rebuild", counts)
    return counts


def rebuild(store: Store, files: DataFrame, now: str, model_id: str, dim: int, embed: Callable[[Column], Column] | None = None, **defaults) -> dict[str, int]:
    """Index ``files`` from nothing, also for another model; audit records stay."""
    store.rebuild(model_id, dim)
    return index_files(store, files, now, embed=embed, **defaults)
