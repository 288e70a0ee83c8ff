"""Near-duplicates, personal data and mixtures."""

import itertools
import random
import re

import numpy as np

from lodestone.llm import mixture, neardup, pii


def shingles(text):
    n = re.sub(r"[\W_]+", " ", text.lower())
    return {n[i : i + 5] for i in range(len(n) - 4)}


def test_normalise_equals_regex():
    texts = ["A-b  C!", "", "ÀÉ—x_y", "...", "İx", "中文，测试 123", "tail!!", "\ud800 odd"]
    assert neardup.normalise_all(texts) == [re.sub(r"[\W_]+", " ", t.lower()) for t in texts]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 20, 80)))]
        rows.append((f"k{i}", " ".join(base)))
        for j in range(rng.randrange(4)):
            changed = list(base)
            for _ in range(rng.randrange(1 + len(base) // 15)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((f"k{i}-{j}", ", ".join(changed).upper()))
    rows += [(f"same{i}", "one text that is there many times over") for i in range(30)] + [("n", None), ("e", ""), ("s", "abc"), (None, "one text that is there many times over"), ("same0", "one text that is there many times over")]
    sets = {k: shingles(t) for k, t in rows if k and t and shingles(t)}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "chunk_id string, text string, norm string, key int")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and not set(got) - wanted
    sure = {(a, b) for a, b in wanted if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    assert sure <= set(got) and len(sure) > 435
    assert neardup.near_duplicate_pairs(df.where("false")).count() == 0


def test_digests_agree_as_often_as_texts():
    a = " ".join(f"word{i}" for i in range(100))
    b = " ".join(f"word{i}" for i in range(20, 120))
    d, some = neardup.digests([a, b, "ab"], 5)
    one, two = shingles(a), shingles(b)
    assert abs(float(np.mean(d[0] == d[1])) - len(one & two) / len(one | two)) < 0.15 and list(some) == [True, True, False]


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(11)
    rows, wanted = [], set()
    while len(wanted) < 800:
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
        start = rng.randrange(5, 30)
        one, two = " ".join(words), " ".join([*words[:start], *(w[::-1] + "x" for w in words[start : start + 13]), *words[start + 13 :]])
        a, b = shingles(one), shingles(two)
        if 0.6 <= len(a & b) / len(a | b) <= 0.62:
            n = len(wanted)
            rows += [(f"{n:03}a", one), (f"{n:03}b", two)]
            wanted.add((f"{n:03}a", f"{n:03}b"))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert got <= wanted and len(wanted - got) <= 6, len(wanted - got)
    assert neardup.expected_recall(0.6) > 0.997 and neardup.expected_recall(0.65) > 0.9998


def test_minima_follow_from_the_threshold():
    assert neardup.postings_needed(0.6, 5, 0.002) == 77 and neardup.postings_needed(0.8, 5, 0.002) == 16
    assert neardup.least_of(77, 0.6**5, 0.002) == 1 and neardup.least_of(200, 0.6**5, 0.002) == 6
    for similarity in (0.6, 0.7, 0.9, 1.0):
        assert neardup.expected_recall(similarity, threshold=similarity) > 0.995


def test_texts_and_postings_are_never_broadcast(spark):
    df = spark.createDataFrame([("a", "one short text"), ("b", "one short text")], "chunk_id string, text string")
    for result in (neardup.near_duplicate_pairs(df), neardup.duplicate_classes(df)):
        result.collect()
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()


def test_large_classes_are_expanded_whole(spark):
    rows = [(f"a{i:03}", "the very same text of many rows") for i in range(30)] + [(f"b{i:03}", "The very same text of many rows, too") for i in range(25)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, per_salt=4).collect()}
    assert got == set(itertools.combinations(sorted(k for k, _ in rows), 2))
    classes = neardup.duplicate_classes(df).collect()
    assert sorted({(r["n_copies"], r["n_links"]) for r in classes}) == [(25, 1), (30, 1)] and len({r["class_id"] for r in classes}) == 2


PERSONAL = "Ask Nadia Drovumbra at nadia.d (at) example [dot] org or +44 7700 900855; she lives at 12 Coppergate Terrace, Norwell 00123. SSN 932-97-8204."


def test_entities():
    got = [(k, PERSONAL[a:b]) for k, a, b in pii.find_entities(PERSONAL)]
    assert got == [("name", "Nadia Drovumbra"), ("email", "nadia.d (at) example [dot] org"), ("phone", "+44 7700 900855"), ("address", "12 Coppergate Terrace, Norwell 00123"), ("id_number", "932-97-8204")]
    for text in ("Checksum 001122332424455 matched for a.md.", "Pinned @tools/walker@2.16.10 in x.ts.", "Use agent@stage-2 as the alias, not x@local.", "Ratio 3.1415645 for Night Walker at v8.19.16.", "Rows 4000-4430 of Old Archive were read.", ""):
        assert pii.find_entities(text) == [], text
    zh = "用户巫望舒（证件号 99664319870412537X）住在青堰市北渡区柳溪路45号。"
    assert [zh[a:b] for _, a, b in pii.find_entities(zh)] == ["巫望舒", "99664319870412537X", "青堰市北渡区柳溪路45号"]


def test_found_and_redacted(spark):
    rows = [(1, PERSONAL), (2, "DROVUMBRA, Nadia called Felix Ostransky."), (3, "nothing"), (4, None), (5, ""), (1, PERSONAL)]
    df = spark.createDataFrame([(i, t, "old", "k") for i, t in rows], "chunk_id long, text string, redacted string, kind string")
    assert pii.find_personal_data(df).count() == 7
    marked = {r["chunk_id"]: r["redacted"] for r in pii.redact(df, "s", placeholders=True).collect()}
    assert marked[1] == "Ask [NAME] at [EMAIL] or [PHONE]; she lives at [ADDRESS]. SSN [ID_NUMBER]." and marked[3] == "nothing" and marked[4] is None and marked[5] == ""
    out = pii.redact(df, "s")
    assert out.count() == 6 and out.columns.count("redacted") == 1
    new = {r["chunk_id"]: r["redacted"] for r in out.collect()}
    name = re.match(r"Ask (\w+ \w+) at", new[1])[1]
    assert name in new[2] and "Nadia" not in new[1] and new[1].split()[1] in pii.GIVEN["f"].split()
    assert pii.redact(df.where("false"), "s").count() == 0


def test_surrogates_are_distinct(spark):
    df = spark.createDataFrame([("phone", f"+{i:03d}") for i in range(300)] + [("name", f"nadia x{i}") for i in range(200)], "kind string, canonical string")
    out = pii.assign_surrogates(df, "key").collect()
    assert len(out) == 500 and len({(r["kind"], r["surrogate"]) for r in out}) == 500


def test_surrogates_of_names_are_distinct_and_not_real(spark):
    han = [("name", a + b + c) for a in "王李张" for b in pii._HAN_GIVEN[:60] for c in pii._HAN_GIVEN[:40]]
    latin = [("name", f"anna {a}{b}") for a in ("mur", "kol", "sta", "rev", "ost") for b in range(400)] + [("name", f"{g.lower()} smith") for g in pii._GENDER] + [("name", "smith")]
    df = spark.createDataFrame(han + latin, "kind string, canonical string")
    out = {r["canonical"]: r["surrogate"] for r in pii.assign_surrogates(df, "key").collect()}
    assert len(out) == len(set(han + latin)) == len(set(out.values())) and not any("-" in v and v.rpartition("-")[2].isdigit() for v in out.values())
    assert not {v.casefold() for v in out.values()} & set(out)
    assert all(len(v) == 3 for k, v in out.items() if k[0] in "王李张") and len({out[c][0] for _, c in han if c[0] == "王"}) == 1
    assert {out[f"{g.lower()} smith"].split()[1] for g in pii._GENDER} == {out["smith"]}
    families = {k.split()[1]: v.split()[1] for k, v in out.items() if k.startswith("anna ")}
    assert len(set(families.values())) == len(families)


def test_names_are_learned_from_the_corpus(spark):
    texts = ["Anna Okoro and Peter Okoro met.", "Then Zodwa Okoro spoke.", "Mr. Tiangco said so.", "Liwayway Tiangco agreed.", "The Cache Okoro is none.", "A Cache holds it, the Cache does.", "Later Okoro left.", "It came later, later still.", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "chunk_id int, text string, word string")
    assert {r["word"] for r in pii.learn_names(df).collect()} == {"Zodwa", "Liwayway"}
    few = {(r["chunk_id"], r["entity"]) for r in pii.find_personal_data(df).collect()}
    assert few == {(0, "Anna Okoro"), (0, "Peter Okoro"), (1, "Zodwa Okoro"), (2, "Tiangco"), (3, "Liwayway Tiangco")}
    assert {(r["chunk_id"], r["entity"]) for r in pii.find_personal_data(df, most_sent=1).collect()} == few
    assert pii.learn_names(df.where("false")).count() == 0 and pii.find_personal_data(df.where("false")).count() == 0


def test_surrogates_keep_layout_and_family():
    def new(kind, entity):
        return pii.as_mentioned(kind, entity, pii.surrogate(kind, pii.canonical_entity(kind, entity), "key"))

    def shape(s):
        return re.sub(r"[A-Za-z]", "x", re.sub(r"\d", "9", s))

    for kind, entity in (("phone", "+49 (30) 123-4567"), ("phone", "06 12 34 56 78"), ("id_number", "12345678-z"), ("id_number", "AB 12 34 56 C")):
        assert shape(new(kind, entity)) == shape(entity) and new(kind, entity) != entity
    spelt, plain = new("email", "jo.doe (at) mail (dot) org"), new("email", "Jo.Doe@mail.org")
    assert spelt == plain.replace("@", " (at) ").replace(".", " (dot) ")
    full, turned, alone, other = (new("name", n) for n in ("Anna Müller", "MÜLLER, Anna", "Müller", "Karl Müller"))
    given, family = full.split()
    assert turned == full and alone == family and other.split()[1] == family
    assert given in pii.GIVEN["f"].split() and other.split()[0] in pii.GIVEN["m"].split()
    assert re.fullmatch(r"\d{2} \w+ \w+ Road, Apt \d, \w+, IL \d{5}", new("address", "12 Elm Tree Road, Apt 4, Springfield, IL 62704"))
    assert re.fullmatch(r"\w+strasse \d\da, \d{5} \w+", new("address", "Lindenstraße 12a, 10115 Berlin"))
    assert re.fullmatch(r"\d\d bis, rue des \w+, \d{5} \w+", new("address", "12 bis, rue des Lilas, 75011 Paris"))
    assert re.fullmatch("[一-鿿]+市[一-鿿]+区[一-鿿]+路\\d+号", new("address", "浙江省杭州市西湖区文三路12号"))


def test_mix_meets_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["token"] * rng.randrange(5, 60)), ["Big", "big ", "small", "mid-size", None, "other"][min(5, i % 17 // 3)]) for i in range(1500)] + [(9001, None, "small"), (9002, "", "small"), (None, "x", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.4, 3), ("mid_size", 0.2, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture.draw_mix(df, targets)
    used = {r["source"]: r for r in report.collect()}
    for source, share in (("big", 0.3), ("small", 0.4), ("mid_size", 0.2)):
        assert abs(used[source]["actual_share"] - share / 0.9) < 0.01
    assert used["absent"]["tokens_used"] == 0
    most = {"big": 2, "small": 3, "mid_size": 4}
    got = mix.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies_used"] <= most[r["source"]] for r in got)
    again = {(r["doc_id"], r["copies_used"]) for r in mixture.draw_mix(df.repartition(3), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies_used"]) for r in got}
    assert mixture.draw_mix(df.where("false"), targets)[0].count() == 0
    assert mixture.draw_mix(df, targets.where("false"))[0].count() == 0


def test_mix_of_whole_uses_is_spread(spark):
    """Where every document is used as often as it may be, none has odds and the ranks aren't one bin."""
    df = spark.createDataFrame([(i, "token " * (1 + i % 7), "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture.draw_mix(df, targets, total_tokens=float(10**9))
    assert {r["copies_used"] for r in mix.collect()} == {2} and mix.count() == 400
    half = {r["source"]: r for r in mixture.draw_mix(df, targets)[1].collect()}
    assert abs(half["a"]["actual_share"] - 0.5) < 0.01
