"""Evaluation leaks and look-alike text, against brute force."""

import random

import pytest

from lodestone.llm import leak, lookalike


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, lang string, text string")


def docs(spark, rows, extra="z"):
    return spark.createDataFrame([(*r, extra) for r in rows], "doc_id long, text string, item_id string")


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    made = [(i, "en", " ".join(rng.choice(words) for _ in range(20))) for i in range(5)] + [(5, "zh", "".join(rng.choice("甲乙丙丁") for _ in range(30))), (6, "en", "too short"), (7, None, None)]
    texts = []
    for i in range(120):
        parts = [rng.choice(words) for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            source = made[i % 5][2].split()
            at = rng.randrange(8)
            parts[3:3] = source[at : at + rng.choice((11, 12, 13))]
        text = rng.choice((" ", ", ", "\n")).join(parts)
        if i % 4 == 0:
            text += " " + " ".join(made[5][2][2 : 2 + rng.choice((19, 20, 25))])
        texts.append((i, text.upper() if i % 5 == 0 else "**" + text + "**"))
    texts += [(900, None), (901, ""), (5, texts[5][1])]
    wanted = set()
    for d, text in texts:
        row = leak.words_of(text or "")
        joined = "".join(row)
        for item, lang, source in made:
            if source is None:
                continue
            if lang == "zh":
                units = leak.characters_of(source)
                hit = any(units[k : k + 20] in joined for k in range(len(units) - 19))
            else:
                units = leak.words_of(source)
                hit = any(row[a : a + 12] == units[k : k + 12] for k in range(len(units) - 11) for a in range(len(row) - 11))
            if hit:
                wanted.add((d, item))
    found = leak.find_leaks(docs(spark, texts), items(spark, made))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    parts = leak.find_leaks(docs(spark, texts), items(spark, made), block_bytes=1500)
    assert {tuple(r) for r in parts.collect()} == wanted


def test_leaks_of_empty_tables(spark):
    none = docs(spark, [(1, "a b")]).where("false")
    assert leak.find_leaks(none, items(spark, [(1, "en", "a " * 20)])).count() == 0
    assert leak.find_leaks(docs(spark, [(1, "a b")]), items(spark, [(1, "en", "x")]).where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"),
        ("café naïve", "café naïve"),
        ("zero​width so­ft", "zerowidth soft"),
        ("conﬁg", "config"),
        ("ﾃﾞｰﾀ", "データ"),
        ("a b c", "a b c"),
        ("x² ½ … ①", "x² ½ … ①"),
        ("", ""),
    ],
)
def test_fold(text, wanted):
    assert lookalike.fold(text) == wanted


def test_readings():
    assert lookalike.reading("wатcher") is None  # Cyrillic т has no Latin twin
    assert lookalike.reading("wаtchеr") == "watcher"
    assert lookalike.reading("ԁе") == "de"
    assert lookalike.reading("а̀") == "à"
    assert lookalike.reading("дом", "Cyrillic") is None


def test_repair_needs_the_vocabulary(spark):
    rows = [(1, "wаtcher here"), (2, "watcher"), (3, "ghоst"), (4, None), (5, ""), (6, "по дому"), (1, "wаtcher here")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "id long, text string, unified string")
    wanted = [(1, "watcher here"), (1, "watcher here"), (2, "watcher"), (3, "ghоst"), (4, None), (5, ""), (6, "по дому")]
    for most in (1000, 0):  # sent to the tasks, and joined
        out = lookalike.unify(df, most_sent=most)
        assert sorted(((r["id"], r["unified"]) for r in out.collect()), key=str) == sorted(wanted, key=str)
    assert lookalike.unify(df.where("false")).count() == 0


def test_find_lookalikes(spark):
    rows = [("a", "see wаtcher plan 7 now"), ("b", "see watcher plan 7"), ("c", "watcher\nplan 7"), ("d", "Watcher plan 7"), ("e", "watcher  plan 7"), ("f", "watcher plan 7"), ("g", None), ("f", "watcher plan 7")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, text string, case_id int")
    queries = spark.createDataFrame([("q", "watcher plan 7"), ("n", None), ("s", "  ")], "case_id string, query string")
    assert sorted(tuple(r) for r in lookalike.find_lookalikes(df, queries).collect()) == [("q", "a"), ("q", "f")]
    assert lookalike.find_lookalikes(df, queries.where("false")).count() == 0
    assert lookalike.find_lookalikes(df.where("false"), queries).count() == 0


def test_matcher_equals_plain_search():
    rng = random.Random(8)
    for by_word, span, block in ((True, 4, 2), (True, 2, 2), (False, 5, 3), (False, 1, 1)):
        letters = ["ab", "c", "d"] if by_word else list("甲乙丙")
        joint = " " if by_word else ""
        make = lambda n: joint.join(rng.choice(letters) for _ in range(n))
        texts, ids = [make(rng.randrange(span, 9)) for _ in range(12)], [rng.randrange(6) for _ in range(12)]
        split = (lambda t: t.split()) if by_word else (lambda t: t)
        matcher = leak.WuManber([split(t) for t in texts], ids, by_word, span, block)
        corpus = ["", make(span - 1), *[make(rng.randrange(60)) for _ in range(200)]]
        windows = {}
        for t, i in zip(texts, ids, strict=True):
            units = split(t)
            for k in range(len(units) - span + 1):
                windows.setdefault(tuple(units[k : k + span]), set()).add(i)
        wanted = {(n, i) for n, t in enumerate(corpus) for k in range(len(split(t)) - span + 1) for i in windows.get(tuple(split(t)[k : k + span]), ())}
        got = matcher.find([split(t) for t in corpus])
        assert len(got) == len(set(got)) and set(got) == wanted


def test_long_documents_and_items_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(leak, "_SLICE", 50)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(f"p{i}" for i in range(12))
    matcher = leak.WuManber([passage.split()], [7], True, 12, 2)
    for at in (0, 37, 44, 49, 50, 51, 4988, 5000):
        assert matcher.find([[*words[:at], *passage.split(), *words[at:]]]) == [(0, 7)]
    monkeypatch.setattr(leak, "_ITEM_SLICE", 800)
    long_item = " ".join(words)
    found = leak.find_leaks(docs(spark, [(i, " ".join(words[a : a + n])) for i, (a, n) in enumerate([(95, 12), (88, 12), (4988, 12), (100, 11), (0, 5000)])]), items(spark, [(1, "en", long_item), (1, "en", long_item)]))
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1, 2, 4]


def test_many_blocks_of_queries_find_the_same(spark):
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["a ｆｕｌｌ width", "a full width", "pl​ain words", None, ""])], "chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "full"), ("q2", "plain words"), ("q3", " "), ("q4", None), ("q5", "width")], "case_id string, query string")
    one = {tuple(r) for r in lookalike.find_lookalikes(rows, queries).collect()}
    assert one == {("q1", "c0"), ("q2", "c2")} and {tuple(r) for r in lookalike.find_lookalikes(rows, queries, block_bytes=300).collect()} == one
