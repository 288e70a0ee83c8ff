"""Segmentation, search, evaluation, store, ingestion and sources."""

import json
import math
import os
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import evaluate, retrieval, segment, store
from lodestone.operators.lexical import bm25, rank_bm25
from lodestone.operators.vector import nearest, stub_vector
from lodestone.plans.ingest import index_files, rebuild
from lodestone.plans.search import search
from lodestone.sources.markdown import read_jsonl, read_markdown, walk


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.canonical, " a \r\nb\t\r\n\r\n\r\n\r\nc ") == "a\nb\n\nc"
    assert one(spark, X.summary, "# head\n\n- 1. item one\nrest") == "item one"
    assert one(spark, X.summary, "## only\n \n") == "(empty section)"
    assert one(spark, X.importance, "We decided. Remember this: docker and flutter on 2025-01-02. " + "x" * 80) == pytest.approx(1.0)
    assert one(spark, X.importance, "short") == pytest.approx(0.2)
    assert one(spark, lambda c: X.first_date(F.lit("no"), c, F.lit("f")), "中2026-5-1文") == "2026-05-01T00:00:00.000Z"


def test_sections_and_paragraphs(spark):
    df = spark.createDataFrame([("a", "# T\nintro\n## One\nx\n\n## Two ##\n```\n## in code\n"), ("b", "no heading"), ("c", None), ("d", "\n# late\n")], "id string, text string")
    got = {(r["id"], r["section"]): (r["title"], r["line_start"], r["line_end"]) for r in segment.sections(df, "id").collect()}
    assert got[("a", 0)] == ("T", 1, 2) and got[("a", 1)] == ("One", 3, 5) and got[("a", 2)] == ("Two", 6, 7) and got[("a", 3)] == ("in code", 8, 9)
    assert got[("b", 0)] == ("(top)", 1, 1) and got[("d", 0)] == ("(top)", 1, 3) and not any(k[0] == "c" for k in got)


def test_packing_and_overlap(spark):
    text = "\n\n".join("x" * n for n in (400, 400, 200, 950, 10))
    df = spark.createDataFrame([("a", text)], "id string, text string")
    assert [r["n_chars"] for r in segment.pack_paragraphs(df, "id").orderBy("chunk").collect()] == [802, 200, 950, 10]
    out = spark.createDataFrame([(["aaaa", "b", "c"],)], "t array<string>").select(segment.with_overlap(F.col("t"), 3).alias("x")).first()["x"]
    assert out == ["aaaa", "aaa\n\nb", "b\n\nc"]  # the tail of the second piece is "\n\nb", trimmed


def test_bm25_equals_fts5(spark):
    docs = ["the cold cache plan", "cache cache of a plan in the sandbox", "nothing here", "content-adapter cold", "adapter content cold cache", "a b c d e f g"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61 remove_diacritics 2')")
    for i, d in enumerate(docs):
        con.execute("insert into f(rowid, t) values (?, ?)", (i, d))
    wanted = dict(con.execute("select rowid, bm25(f) from f where f match '\"cold\" OR \"cache\" OR \"content-adapter\" OR \"cold\"'").fetchall())
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string")
    queries = spark.createDataFrame([("q", "cold cache content-adapter cold")], "query_id string, query string")
    got = {r["chunk_id"]: r["score"] for r in bm25(chunks, queries).collect()}
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], abs_tol=1e-8) for k in got)


def test_stub_vector_and_nearest(spark):
    import hashlib
    import struct

    digest = hashlib.sha256(b"0\x00hello").digest()
    assert one(spark, lambda c: stub_vector(c), "hello") == [v / 0x7FFFFFFF for v in struct.unpack("<8i", digest)]
    v = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(9)], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<double>")
    assert [r["chunk_id"] for r in nearest(v, q, 3).orderBy("rank").collect()] == [1, 5, 0]


def test_every_reject_reason(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"m{i}", "t", "p.md", 1, 2) for i in range(1, 9)], "chunk_id string, memory_id string, text string, source_path string, line_start int, line_end int")
    rows = [("m1", "episode", "active", "compiled", "p", "c", 0.9, 0.5, "2026-06-30"), ("m2", "episode", "archived", "compiled", "p", "c", 0.9, 0.5, "2026-06-30"), ("m3", "fact", "active", "compiled", "p", "c", 0.9, 0.5, "2026-06-30"), ("m4", "episode", "active", "tool_observed", "p", "c", 0.9, 0.5, "2026-06-30"), ("m5", "episode", "active", "compiled", None, "c", 0.9, 0.5, "2026-06-30"), ("m6", "episode", "active", "compiled", "p", "x", 0.9, 0.5, "2026-06-30"), ("m7", "episode", "active", "compiled", "p", "c", 0.9, 0.5, "2020-01-01")]
    memories = spark.createDataFrame(rows, "memory_id string, memory_type string, status string, source_kind string, project string, channel string, confidence double, importance double, m string").withColumn("moment", F.to_timestamp("m"))
    hits = spark.createDataFrame([("q", f"c{i}", i, None, 0.01) for i in range(1, 10)], "query_id string, chunk_id string, semantic_rank int, lexical_rank int, score double")
    policy = retrieval.Policy(types=("episode",), source_kinds=("compiled",), project="p", channel="c", max_age_days=30)
    got = {r["chunk_id"]: r["reason"] for r in retrieval.judged(hits, chunks, memories, policy, F.lit("2026-07-01").cast("timestamp")).collect()}
    assert got == {"c1": None, "c2": "status:archived", "c3": "type:fact", "c4": "sourceKind:tool_observed", "c5": "project:none", "c6": "channel:x", "c7": "older_than_30d", "c8": "missing_memory_row", "c9": "missing_chunk_row"}


def test_labels_rule_gives_false_memory_failure(spark):
    cases = spark.createDataFrame([(f"c{i}",) for i in range(6)], "case_id string")
    labels = spark.createDataFrame([("c0", "ok", 1), ("c1", "ok", 1), ("c2", "partial", 1), ("c3", "ok", 1), ("c3", "wrong", 2), ("c4", "wrong", 1), ("zz", "wrong", 1)], "case_id string, verdict string, labeled_at long")
    trusted = evaluate.trust(cases, labels)
    assert trusted.first().asDict() == {"labeled": 5, "wrong": 2, "false_memory_rate": 0.4}
    overall = spark.createDataFrame([(6, 1.0, 1.0, 50.0)], "cases long, hit_rate_at_k double, citation_shape_ok double, avg_tokens double")
    assert evaluate.gates(overall, trusted).first().asDict() == {"passed": False, "failures": "false_memory"}
    assert evaluate.gates(overall, evaluate.trust(cases, labels.where("false"))).first()["passed"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "memory"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "node_modules").mkdir()
    for name, text in {"a.md": "# A\nintro\n\n## One\nfirst text\n\n## Two\nsecond", "sub/B.MD": "plain", "_x.md": "kept", ".git/no.md": "x", "node_modules/no.md": "x", "no.txt": "x"}.items():
        (root / name).write_text(text)
    os.symlink(root / "a.md", root / "link.md")
    (tmp_path / "MEMORY.md").write_text("top")
    return root


def test_walk_and_read(spark, tree):
    assert [p for p, _, _ in walk(str(tree))] == ["a.md", "_x.md", "sub/B.MD"]
    assert walk(str(tree), include_parent=True)[-1][0] == "../MEMORY.md"
    assert {r["path"]: r["text"] for r in read_markdown(spark, str(tree)).collect()}["_x.md"] == "kept"


def test_jsonl(spark, tmp_path):
    path = tmp_path / "set.jsonl"
    path.write_text('\n// note\n# note\n{"id": "a", "query": "q"}\n{"id": "b"}\n{bad\n')
    schema = "id string, query string"
    assert read_jsonl(spark, str(path), schema, ("id", "query"), drop_bad=True).count() == 1
    with pytest.raises(Exception, match="bad record"):
        read_jsonl(spark, str(path), schema, ("id", "query")).collect()


def test_index_is_incremental_and_retires(spark, tree, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"), "stub", 8)
    files = read_markdown(spark, str(tree)).select("path", "text")
    assert index_files(s, files, "2026-01-01 00:00:00") == {"files_scanned": 3, "files_changed": 3, "sections": 5, "changed": 5, "unchanged": 0, "archived": 0, "chunks": 5, "embedded": 5}
    again = index_files(s, files, "2026-01-02 00:00:00")
    assert again["changed"] == 0
    (tree / "a.md").write_text("# A\nintro\n\n## One\nfirst text, edited\n")
    assert index_files(s, read_markdown(spark, str(tree)).select("path", "text"), "2026-01-03 00:00:00")["changed"] == 1
    status = {r["status"]: r["n"] for r in s.read("memories").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert status == {"active": 4, "archived": 2}
    assert s.read("vectors").count() == s.read("lengths").count() == s.read("chunks").count() == 6
    with pytest.raises(ValueError, match="rebuild"):
        store.Store(spark, str(tmp_path / "index"), "other", 8)
    assert s.meta()["embedding_dim"] == "8"


def test_store_search_equals_brute_force(spark, tree, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"), "stub", 8)
    (tree / "a.md").write_text("# A\nintro\n\n## One\nfirst text on caches\n\n## Two\nsecond text, on cold caches 2026-06-20\n")
    files = read_markdown(spark, str(tree)).select("path", "text")
    index_files(s, files, "2026-06-30 00:00:00")
    queries = spark.createDataFrame([("q1", "  cold caches ", 2), ("q2", "plain", None)], "query_id string, query string, k int")
    now = F.lit("2026-07-01").cast("timestamp")
    got = search(s, queries, now).orderBy("query_id", "position").collect()
    assert [r["query_id"] for r in got].count("q1") == 2 and got[0]["summary"] == "second text, on cold caches 2026-06-20"
    assert got[0]["citation"] == "a.md#L7-L8" and got[0]["confidence"] == 1.0 and got[0]["why"].startswith("semantic_similarity|lexical_match|lexical_match:cold|recent_within_30d")
    wanted = {(r["query_id"], r["chunk_id"]): r["rank"] for r in bm25(s.read("chunks"), queries).collect()}
    assert wanted == {(r["query_id"], r["chunk_id"]): r["rank"] for r in rank_bm25(s.read("postings"), s.read("lengths"), queries).collect()}
    audit = s.audit().where("kind = 'retrieve'").select(F.get_json_object("payload_json", "$.query").alias("q"), F.get_json_object("payload_json", "$.topK").alias("k")).collect()
    assert sorted(map(tuple, audit)) == [("cold caches", "2"), ("plain", "5")]
    with pytest.raises(Exception, match="empty"):
        search(s, spark.createDataFrame([("q", " ")], "query_id string, query string"), now)
    one = got[0]
    assert s.by_id("memories", "memory_id", one["memory_id"]).count() == 1 and s.by_id("chunks", "chunk_id", one["chunk_id"]).first()["source_path"] == "a.md"


def test_only_touched_buckets_are_published(spark, tree, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"), "stub", 8)
    files = lambda: read_markdown(spark, str(tree)).select("path", "text")
    index_files(s, files(), "2026-01-01 00:00:00")
    before = s._manifest()
    assert index_files(s, files(), "2026-01-02 00:00:00")["embedded"] == 0 and s.version == before["version"]
    (tree / "_x.md").write_text("kept, and changed")
    counts = index_files(s, files(), "2026-01-03 00:00:00")
    after = s._manifest()
    moved = {b for b, v in after["tables"]["memories"].items() if v == after["version"]}
    assert counts["changed"] == counts["archived"] == counts["embedded"] == 1 and 1 <= len(moved) <= 2
    assert all(after["tables"]["memories"][b] == v for b, v in before["tables"]["memories"].items() if b not in moved)
    s.set_meta("note", "x")
    n = s.read("memories").count()
    assert s.vacuum(1) > 0 and s.read("memories").count() == n == 6 and s.meta()["note"] == "x"
    with pytest.raises(Exception, match="(?i)exists"):
        s._commit(s._manifest())
    rebuild(s, files(), "2026-01-04 00:00:00", "other", 3)
    assert s.meta()["embedding_model_id"] == "other" and len(s.read("vectors").first()["vector"]) == 3 and s.audit().where("kind = 'rebuild'").count() == 4
    assert {r["status"] for r in s.read("memories").collect()} == {"active"}
    assert store.set_status(s.read("memories"), [s.read("memories").first()["memory_id"]], "superseded").where("status = 'superseded'").count() == 1


def test_records_have_the_fields_of_hints_and_defaults(spark):
    from lodestone.plans.ingest import extract_memories

    text = '# T\n\n## A\n```memory\n{"tags": ["x"], "entities": [], "provenance": {"sourceKind": "compiled"}, "confidence": 0.5}\n```\n\n## B\nsame\n\n## B\nsame\n'
    files = spark.createDataFrame([("a.md", text)], "path string, text string")
    rows = {json.loads(r["json"])["title"]: r for r in extract_memories(files, "2026-01-01 00:00:00", scope="project", project="p").collect()}
    assert set(rows) == {"T", "A", "B"} and rows["A"]["source_kind"] == "compiled" and rows["A"]["confidence"] == 0.5 and rows["B"]["confidence"] == 1.0
    assert rows["B"]["source_kind"] == "human_confirmed" and rows["B"]["scope"] == "project" and rows["B"]["project"] == "p" and rows["B"]["line_start"] == 8
    assert json.loads(rows["A"]["json"])["tags"] == ["x"] and json.loads(rows["B"]["json"])["participants"] == ["user", "assistant"]
    put_in = spark.createDataFrame([("a.md", text.replace("## B", "## New\nwords\n\n## B", 1))], "path string, text string")
    assert {r["memory_id"] for r in rows.values()} <= {r["memory_id"] for r in extract_memories(put_in, "2026-01-01 00:00:00").collect()}


def test_providers(spark):
    from lodestone.operators.vector import HttpProvider, OnnxProvider, embed_with

    class Fixed:
        model_id, dim = "fixed", 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    assert [list(r["v"]) for r in df.select(embed_with(Fixed, 2)("t").alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="don't have 3 dimensions"):
        df.select(embed_with(Fixed, 3)("t")).collect()
    sent = []

    def post(url, body):
        sent.append((url, len(body["input"])))
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    assert HttpProvider("m", 1, post, "http://localhost/v1/").embed(["x" * i for i in range(70)]) == [[float(i)] for i in range(70)]
    assert sent == [("http://localhost/v1/embeddings", 64), ("http://localhost/v1/embeddings", 6)]
    with pytest.raises(ValueError, match="gave 0 vectors"):
        HttpProvider("m", 1, lambda u, b: {"data": []}, "u").embed(["a"])

    class Session:
        def run(self, _, inputs):
            return [np.stack([inputs["input_ids"], np.ones_like(inputs["input_ids"])], axis=-1).astype(float)]

    seen = []

    def encode(texts):
        seen.extend(texts)
        return np.array([[3, 5, 9]] * len(texts)), np.array([[1, 1, 0]] * len(texts))

    (v,) = OnnxProvider("tiny-e5", 2, Session(), encode).embed(["hi"])
    assert seen == ["passage: hi"] and v == pytest.approx([4 / 17**0.5, 1 / 17**0.5])


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist() if i % 3 else [0.5] * 6) for i in range(400)] + [(1000, None), (None, [0.0] * 6), (1001, [None] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:20])], "query_id long, vector array<double>")
    kept = [(k, np.array(x)) for k, x in rows if k is not None and k < 1000]
    wanted = {}
    for i, x in enumerate(r[1] for r in rows[:20]):
        near = sorted((round(float(np.sqrt(((y - np.array(x)) ** 2).sum())), 9), k) for k, y in kept)[:7]
        wanted[i] = [k for _, k in near]
    for limit in (64_000_000, 0):
        got = {}
        for r in nearest(v, q, 7, "vec_id", block=32, most_broadcast=limit).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == wanted
    assert nearest(v.where("false"), q, 7, "vec_id").count() == 0 and nearest(v, q.where("false"), 7, "vec_id").count() == 0


def test_config(tmp_path):
    from lodestone import config

    path = str(tmp_path / "sub" / "config.json")
    assert config.load_or_init(path) == config.Config() == config.load_or_init(path)
    config.save(config.Config(retrieval=config.Retrieval(top_k=7)), path)
    assert config.load_or_init(path).retrieval.top_k == 7
    for bad in ('{"retrieval": {"min_score": 2}}', '{"default_scope": "moon"}', '{"x": 1}', "{broken", '{"embedding": {"dim": 0}}', "[]"):
        (tmp_path / "sub" / "config.json").write_text(bad)
        with pytest.raises(ValueError, match="config.json"):
            config.load_or_init(path)


def test_reports_and_labels(spark, tmp_path):
    from lodestone.sources.markdown import read_labels
    from lodestone.sources.reports import as_json, as_text, write_report

    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r["value"] for r in as_json(df).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert [r["value"] for r in as_text(df).collect()] == ["a=1  b=-", "a=2  b=x"]
    write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    path = tmp_path / "labels.jsonl"
    assert read_labels(spark, str(path)).count() == 0
    path.write_text('// x\n{"caseId": "a", "verdict": "ok"}\n\n{"caseId": 3, "verdict": "ok"}\n{"caseId": "a", "verdict": "wrong"}\n')
    assert [tuple(r) for r in evaluate.latest_labels(read_labels(spark, str(path))).collect()] == [("a", "wrong")]


def test_trust_issues_and_signals(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    rows = [("a", 2, "m2", "", "fine"), ("a", 1, "m1", "p.md#L1-L2", "key sk-abcdefghijklmnop1234"), ("b", 1, "m3", "x.md", "fine")]
    results = spark.createDataFrame(rows, "case_id string, position int, memory_id string, citation string, summary string")
    labels = spark.createDataFrame([("b", "partial", 1), ("c", "ok", 1)], "case_id string, verdict string, labeled_at long")
    got = {r["case_id"]: (r["issues"], r["citation_violations"], r["secret_hits"]) for r in evaluate.trust_issues(results, labels, cases).collect()}
    assert got == {"a": (["secret_in_summary:m1", "bad_citation:m2"], 1, 1), "b": (["human_label:partial"], 0, 0)}
    assert tuple(evaluate.trust_report(cases, results, labels).first()) == (3, 1, 1, 2, 0, 0.0)
    assert one(spark, X.importance_signals, "short docker") == ["baseline:0.40", "entities(1):+0.05", "too_short:-0.20"]
    none = spark.createDataFrame([], store.AUDIT)
    now = F.lit("2026-07-01").cast("timestamp")
    assert tuple(evaluate.index_age(none, now).first()) == (None, None, "warn") and tuple(evaluate.zero_results(none, now).first()) == (0, 0, None, "ok")


def test_damaged_files_are_marked(spark, tree):
    (tree / "a.md").write_bytes(b"ok \xff\xfe end")
    got = {r["path"]: (r["text"], r["damaged"]) for r in read_markdown(spark, str(tree), include_parent=True).collect()}
    assert got["a.md"] == ("ok \ufffd\ufffd end", True) and got["_x.md"] == ("kept", False) and "../MEMORY.md" in got and len(got) == 4


def test_stream_sees_edits_in_place(spark, tree, tmp_path):
    from lodestone.streaming.watch import watch

    s = store.Store(spark, str(tmp_path / "index"), "stub", 8)
    query = watch(spark, str(tree), s, str(tmp_path / "checkpoint"))
    try:
        deadline = time.time() + 60
        while s.read("memories").count() < 5 and time.time() < deadline:
            time.sleep(1)
        (tree / "a.md").write_text("## Three\nnew words\n")
        os.utime(tree / "a.md", (time.time() + 5, time.time() + 5))
        while s.read("chunks").where("text like '%new words%'").count() == 0 and time.time() < deadline:
            time.sleep(1)
        assert s.read("chunks").where("text like '%new words%'").count() == 1
    finally:
        query.stop()


def test_stream_emits_names_and_keeps_what_cannot_be_read(tree, monkeypatch):
    from lodestone.sources import markdown

    reader = markdown._EditedFiles({"path": str(tree)})
    rows, first = reader.read({})
    rows = list(rows)
    assert rows and all(len(r) == 3 for r in rows) and "a.md" in first
    os.utime(tree / "a.md", (time.time() + 5, time.time() + 5))
    access = os.access
    monkeypatch.setattr(os, "access", lambda p, mode: not str(p).endswith("a.md") and access(p, mode))
    rows, second = reader.read(first)
    assert list(rows) == [] and second == first
    monkeypatch.undo()
    rows, third = reader.read(second)
    assert [r[0] for r in rows] == ["a.md"]
    (tree / "a.md").unlink()
    rows, fourth = reader.read(third)
    assert list(rows) == [("a.md", None, None)] and "a.md" not in fourth


def test_failed_batches_come_again_and_removed_files_are_archived(spark, tree, tmp_path, monkeypatch):
    from lodestone.streaming import watch as module

    s = store.Store(spark, str(tmp_path / "index"), "stub", 8)
    run = lambda: module.watch(spark, str(tree), s, str(tmp_path / "checkpoint"), available_now=True).awaitTermination(60)

    def fails(*args, **more):
        raise OSError("the disk is full")

    with monkeypatch.context() as m:
        m.setattr(module, "index_files", fails)
        with pytest.raises(Exception, match="the disk is full"):
            run()
    run()
    of_a = s.read("memories").where("json like '%a.md%'")
    n = of_a.count()
    assert n and of_a.where("status = 'archived'").count() == 0
    (tree / "a.md").unlink()
    run()
    after = s.read("memories")
    assert after.where("json like '%a.md%' and status = 'archived'").count() == n and after.where("status = 'active'").count() == after.count() - n


def test_top_k_keeps_all_that_a_query_asks_for(spark):
    rows = spark.range(80).selectExpr("'q' AS query_id", "id AS chunk_id", "1.0D / (id + 1) AS score", "CAST(id AS int) AS semantic_rank", "CAST(NULL AS int) AS lexical_rank", "70 AS k")
    assert [r["position"] for r in retrieval.top_k(rows, "k").orderBy("position").collect()] == list(range(1, 71))
    assert retrieval.top_k(rows, 3).count() == 3


def test_long_lists_are_cut_at_items(spark):
    text = "\n".join(f"- item {i} " + "x" * 30 for i in range(6)) + "\n\nshort"
    df = spark.createDataFrame([("a", text)], "id string, text string")
    got = segment.pack_paragraphs(df, "id", "text", 100, split_lists=True).orderBy("chunk").collect()
    assert [(r["line_start"], r["line_end"], r["n_chars"]) for r in got] == [(1, 2, 79), (3, 4, 79), (5, 6, 79), (8, 8, 5)]
    assert segment.pack_paragraphs(df, "id", "text", 100).count() == 2


def test_hints(spark):
    from lodestone.plans.ingest import extract_memories, hint_of

    fenced = lambda body: f"## T\n```memory\n{body}\n```\ntext"
    good = one(spark, hint_of, fenced('{"importance": 0.9, "status": "archived", "unknown": 1}'))
    assert good["importance"] == 0.9 and good["status"] == "archived" and good["project"] is None
    for bad in ('{"importance": "high"}', '{"importance": 2}', '{"status": 1, "project": "p"}', "{broken", "[1]"):
        assert one(spark, hint_of, fenced(bad)) is None, bad
    assert one(spark, hint_of, "no block") is None
    files = spark.createDataFrame([("a.md", fenced('{"memoryId": "mem_x", "project": "p"}'))], "path string, text string")
    row = extract_memories(files, "2026-01-01 00:00:00").first()
    assert row["memory_id"] == "mem_x" and row["project"] == "p" and row["status"] == "active"


def test_stale_ranges(spark):
    files = spark.createDataFrame([("a.md", "1\n2\r\n3"), ("b.md", None), ("c.md", "")], "path string, text string")
    rows = [("a.md", 3), ("a.md", 4), ("a.md", None), ("b.md", 1), ("c.md", 2), ("gone.md", 1), (None, 1)]
    chunks = spark.createDataFrame(rows, "source_path string, line_end int").withColumn("n_lines_old", F.lit(0))
    assert tuple(evaluate.stale_ranges(chunks, files).first()) == (7, 2, 2, 4 / 7)
    assert tuple(evaluate.stale_ranges(chunks.where("false"), files).first()) == (0, 0, 0, None)
