"""Visually identical text with different characters, brought to one form.

Two stages.  *Folding* is a rule for each character: full- and half-width forms,
ligatures and radicals become the plain characters, spaces of one width or another
become U+0020, what can't be seen is dropped, accents are composed.  *Repair* is
script-aware: a token that mixes scripts is read in its dominant script (the one
whose letters in it have no twin elsewhere), its look-alike letters are replaced,
and the result is kept only if it occurs in the vocabulary of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.blocks import read_block, write_blocks
from lodestone.session import cut

#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ҺH аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ιi κk υu αa γy",
    "Armenian": "ՕO ՍU օo ոn սu հh ցg զq",
}
_TO_LATIN = {pair[0]: pair[1] for pairs in LOOKALIKES.values() for pair in pairs.split()}
_SCRIPT = {pair[0]: script for script, pairs in LOOKALIKES.items() for pair in pairs.split()}
_FROM_LATIN = {script: {pair[1]: pair[0] for pair in pairs.split()} for script, pairs in LOOKALIKES.items()}
#: Code points of the letters whose scripts are told apart, as ranges.
_RANGES = {"Cyrillic": ((0x400, 0x52F),), "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Armenian": ((0x531, 0x58F),)}
_SUSPECT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for spans in _RANGES.values() for a, b in spans) + "]")
_TOKEN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
_LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
#: Kinds of compatibility decompositions whose result looks the same.
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>")


def _fold_table() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in [*range(0x80, 0x3400), *range(0xF900, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFEFF, 0x10000), *range(0xE0000, 0xE01F0)]:
        c = chr(code)
        category, decomposition = unicodedata.category(c), unicodedata.decomposition(c)
        if category == "Zs":
            table[code] = " "
        elif category == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            table[code] = ""
        elif decomposition.startswith(_SAME_LOOK) and c != "…" and not unicodedata.normalize("NFKC", c).startswith(" "):
            table[code] = unicodedata.normalize("NFKD", c) if decomposition.startswith("<narrow>") else unicodedata.normalize("NFKC", c)
    return table


_FOLD = _fold_table()
#: Within the first plane a class is a table; the others are looked at only in texts that have their characters.
_TO_FOLD = re.compile("[" + "".join(f"\\u{code:04x}" for code in _FOLD if code < 0x10000) + "̀-゙゚ͯ]")
_TO_FOLD_BEYOND = re.compile("[" + "".join(f"\\U{code:08x}" for code in _FOLD if code >= 0x10000) + "]")


def fold(text: str) -> str:
    """One form of what differs only in width, composition or invisible characters."""
    if text.isascii() or not (_TO_FOLD.search(text) or (max(text) > "\uffff" and _TO_FOLD_BEYOND.search(text))):
        return text
    return unicodedata.normalize("NFC", text.translate(_FOLD))


def _script(c: str) -> str:
    code = ord(c)
    for script, spans in _RANGES.items():
        if any(a <= code <= b for a, b in spans):
            return script
    return "Latin" if "LATIN" in unicodedata.name(c, "") else "other"


def reading(token: str, around: str = "Latin") -> str | None:
    """``token`` in its dominant script, or None where it needs or has no repair.

    Letters without a twin in another script decide.  If there are none, the script
    of the surrounding line does.  A token whose letters can't all be written in
    one script is left alone.
    """
    scripts = [(c, _script(c)) for c in unicodedata.normalize("NFD", token)]
    used = {s for _, s in scripts if s != "other"}
    if len(used) == 1 and used == {around}:
        return None
    sure = {s for c, s in scripts if s != "other" and not (c in _TO_LATIN or (s == "Latin" and any(c in _FROM_LATIN[x] for x in used - {"Latin"})))}
    if len(sure) > 1 or (len(used) == 1 and sure):
        return None
    target = sure.pop() if sure else around
    out = []
    for c, s in scripts:
        if s in (target, "other"):
            out.append(c)
            continue
        twin = _TO_LATIN.get(c) if s != "Latin" else c
        if target != "Latin":
            twin = _FROM_LATIN.get(target, {}).get(twin)
        if twin is None:
            return None
        out.append(twin)
    result = unicodedata.normalize("NFC", "".join(out))
    return None if result == token else result


def _line_script(line: str) -> str:
    """The script of most letters of a line that have no twin; Latin where none have."""
    counts: dict[str, int] = {}
    for c in line:
        if c.isalpha() and c not in _TO_LATIN:
            s = _script(c)
            if s != "other":
                counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts), key=counts.get) if counts else "Latin"


def proposals(folded: str) -> dict[str, str]:
    """Suspicious tokens of a folded text and their readings."""
    found: dict[str, str] = {}
    if folded.isascii() or not _SUSPECT.search(folded):
        return found
    for line in _LINE_ENDS.split(folded):
        if not _SUSPECT.search(line):
            continue
        around = _line_script(line)
        for token in _TOKEN.findall(line):
            if _SUSPECT.search(token) and (result := reading(token, around)):
                found[token] = result
    return found


def repair(folded: str, confirmed: frozenset[str] | set[str]) -> str:
    """A folded text with its suspicious tokens in those readings that ``confirmed`` holds."""
    change = {token: result for token, result in proposals(folded).items() if result in confirmed}
    return _TOKEN.sub(lambda m: change.get(m[0], m[0]), folded) if change else folded


def confirmed_readings(texts: DataFrame) -> DataFrame:
    """Readings of suspicious tokens that occur in the vocabulary of column ``text``: column ``word``.

    The vocabulary is every token that is written in one script.  One pass over the
    texts; a task sends a word once a batch, and words are combined before the shuffle.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set[str] = set()
            wanted: set[str] = set()
            for text in batch["text"]:
                if text:
                    folded = fold(text)
                    seen.update(_TOKEN.findall(folded))
                    wanted.update(proposals(folded).values())
            known = [w for w in seen if w.isascii() or not _SUSPECT.search(w) or len({_script(c) for c in w} - {"other"}) == 1]
            yield pd.DataFrame({"word": pd.Series(known + list(wanted), dtype=object), "known": pd.Series([True] * len(known) + [False] * len(wanted), dtype=bool)})

    each = texts.select("text").mapInPandas(words, "word string, known boolean")
    return each.groupBy("word").agg(F.bool_or("known").alias("known"), F.bool_or(~F.col("known")).alias("wanted")).where("known and wanted").select("word")


@F.pandas_udf(T.StringType())
def _fold_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else fold(t) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[] if t is None else sorted(set(proposals(t).values())) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _repair_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, kept in batches:
        yield pd.Series([repair(text, set(words)) for text, words in zip(texts, kept, strict=True)], dtype=object)


def _repair_with(words: list[str]):
    confirmed = frozenset(words)

    @F.pandas_udf(T.StringType())
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else repair(fold(t), confirmed) for t in texts], dtype=object)

    return column


def unify(rows: DataFrame, text: str = "text", into: str = "unified", confirmed: DataFrame | None = None, most_sent: int = 200_000) -> DataFrame:
    """``rows`` with ``into``: column ``text`` in its one consistent form.

    Null stays null, the empty text stays empty.  Line ends are kept.  All rows and
    other columns are kept (an old ``into`` is replaced).  ``confirmed`` (column
    ``word``) are the readings that the corpus confirms; without it they come from
    ``rows`` itself.

    Up to ``most_sent`` confirmed readings are sent to every task, so that one pass
    does it all.  Beyond that they are joined: only suspicious texts are shuffled,
    once for each distinct text, and the result is the same.
    """
    if confirmed is None:
        confirmed = cut(confirmed_readings(rows.select(F.col(f"`{text}`").alias("text"))))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != into]
    words = [r["word"] for r in confirmed.limit(most_sent + 1).collect()]
    if len(words) <= most_sent:
        return rows.select(*kept, _repair_with(words)(F.col(f"`{text}`")).alias(into))
    base = rows.select(*kept, _fold_column(F.col(f"`{text}`")).alias("_folded")).withColumn("_readings", _readings_column("_folded"))
    suspicious = base.where(F.size("_readings") > 0).select("_folded", "_readings").distinct()
    pairs = suspicious.select("_folded", F.explode("_readings").alias("word")).join(confirmed, "word")
    repaired = pairs.groupBy("_folded").agg(F.collect_set("word").alias("words")).select(F.col("_folded").alias("_was"), _repair_column(F.col("_folded"), F.col("words")).alias("_now"))
    clean = base.where(F.size("_readings") == 0).select(*kept, F.col("_folded").alias(into))
    mended = base.where(F.size("_readings") > 0).join(repaired, F.col("_folded") == F.col("_was"), "left").select(*kept, F.coalesce("_now", "_folded").alias(into))
    return clean.unionByName(mended)


def _match(path: str, block: int, key: str):
    def make(rows: pd.DataFrame) -> ahocorasick.Automaton | None:
        by_form: dict[str, list] = {}
        if len(rows):
            for case_id, stored, form in zip(rows["case_id"], rows["query"], rows["form"], strict=True):
                by_form.setdefault(form, []).append((case_id, stored))
        if not by_form:
            return None
        automaton = ahocorasick.Automaton()
        for form, own in by_form.items():
            automaton.add_word(form, own)
        automaton.make_automaton()
        return automaton

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = read_block(path, block, make)
        for batch in batches:
            found = []
            for k, stored_text, form in zip(batch["k"], batch["t"], batch["_unified"], strict=True):
                if not form or automaton is None:
                    continue
                hits = {case for _, own in automaton.iter(form) for case in own}
                found += [(case_id, k) for case_id, stored in sorted(hits) if stored not in stored_text]
            yield pd.DataFrame(found, columns=["case_id", key], dtype=object)

    return run


def find_lookalikes(rows: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text", block_bytes: int = 128_000_000) -> DataFrame:
    """Which rows show a query that they don't store as such: ``case_id, key``.

    ``queries`` has ``case_id`` and ``query``.  A row is a case when the query's
    consistent form occurs within a line of the row's, and the stored query does not
    occur in the stored text.  Null and blank queries, null texts and null keys give
    no row; repeated input rows give one.  The vocabulary is that of rows and queries
    together.

    The queries stay in the shared folder (``llm.blocks``): they are searched in
    blocks whose automata need about ``block_bytes`` in a worker, each in a pass over
    the rows.
    """
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    asked = queries.where(F.col("case_id").isNotNull() & (F.length(F.btrim("query")) > 0)).select("case_id", "query")
    corpus = texts.select(F.col("t").alias("text")).unionByName(asked.select(F.col("query").alias("text")))
    confirmed = cut(confirmed_readings(corpus))
    shown = unify(texts, "t", "_unified", confirmed)
    forms = unify(asked, "query", "form", confirmed).where(F.col("form").rlike(r"\S"))
    # A letter of an automaton takes about a hundred bytes.
    path, n_blocks = write_blocks(forms.distinct().withColumn("cost", F.length("form") * 100 + F.length("query")), "cost", block_bytes)
    found = None
    for block in range(n_blocks):
        hits = shown.mapInPandas(_match(path, block, key), f"case_id string, `{key}` string")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
