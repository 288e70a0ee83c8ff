"""Sentences of documents in many languages and scripts.

Unsupervised, after Kiss and Strunk: all documents are counted once, and for each
language (that of each block, not of a document) log-likelihood ratios tell which types are abbreviations, which words
follow a number's period within a sentence (collocations) and which ones begin
sentences.  Each period is then classified with these statistics.  Scripts that
end sentences with marks or particles of their own need no statistics.

Languages of the Latin script are told apart by function words, which are learned
from labels of the documents where they have some.

The counts are combined in the map tasks and reduced by Spark; what passes the tests
(short types, a few hundred for a language) lies in the shared folder, where the tasks
read it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.blocks import read_block, write_blocks
from lodestone.session import cut

_OPEN, _CLOSE = "\"'“‘„‚«‹「『（([【｢《〈", "\"'”’“»›」』）)]】｣》〉*_"
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "｢": "｣", "《": "》"}
_CLOSING = set("”’»›」』）)]】｣》〉*_")
_OPENED = re.compile("[\"" + "".join(map(re.escape, _PAIRS)) + "]")
_QUOTES_CLOSE = set("\"”’“»›」』｣")
#: Particles that end Thai sentences where a space follows.
THAI_FINALS = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ๊ะ", "จ้า", "ฮะ", "ค่า")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_BULLET = re.compile(r"\s*[-*+•‣·]\s+\S")
_NUMBERED = re.compile(r"\s*(\d{1,3})[.)]\s+\S")
_TURN = re.compile(r"\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\(\d{1,2}:\d{2}(?::\d{2})?\)|\d{1,2}:\d{2}(?::\d{2})? ?[-–—|>])\s*\S")
_RUN = r"(?P<run>[.!?…。！？｡।॥؟۔](?:[.!?…。！？｡।॥؟۔]|(?<=\.) (?=\.))*)"
_END = re.compile(_RUN)
_END_OR_FINAL = re.compile(_RUN + "|(?:" + "|".join(THAI_FINALS) + r")(?=[\s\"”')*_])")
_THAI = re.compile("[\u0e00-\u0e7f]")
_BEFORE_WORD = re.compile("[" + re.escape(_OPEN) + r"\s¿¡*_]*")
_ALNUM, _TOKEN = re.compile(r"[^\W_]*"), re.compile(r"\S*")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_NUMBER = re.compile(r"[-+]?\d[\d.,:]*(?<![.,:])")
_STRIP = _OPEN + _CLOSE + "¿¡,;:"

#: Frequent function words that tell the languages of the Latin script apart.
_FUNCTION_WORDS = {
    "en": "the of and to was that is for it with as on by at one after until because so",
    "de": "der die das und den auf für ist mit ein eine im zum nach dem des wurde nicht",
    "fr": "le la les de du des et est dans pour une un a en que qui sur par pas",
    "es": "el la los las de del y en por para una un que se con al su lo no",
}
_FUNCTION_OF: dict[str, list[str]] = {}
for _language, _words in _FUNCTION_WORDS.items():
    for _word in _words.split():
        _FUNCTION_OF.setdefault(_word, []).append(_language)
_SCRIPTS = (("th", 0x0E00, 0x0E7F), ("hi", 0x0900, 0x097F), ("ar", 0x0600, 0x06FF), ("ru", 0x0400, 0x04FF), ("ko", 0xAC00, 0xD7AF), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF))
#: How much a letter weighs against one of another script: a syllable or a word of Latin has several.
_WEIGHT = {"ko": 2, "ja": 3, "zh": 3}
_SCRIPT_FIND = [(name, re.compile(f"[{chr(a)}-{chr(b)}]+")) for name, a, b in _SCRIPTS]
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]+")


def _letters(part: str, scripts: list) -> dict[str, int]:
    """Weighted letters of each script in all of a block; Han beside kana counts as Japanese, letters of Latin under ``""``."""
    if part.isascii():
        return {}
    found = {name: n * _WEIGHT.get(name, 1) for name, pattern in scripts if (n := len("".join(pattern.findall(part))))}
    if "ja" in found and found["ja"] >= 0.05 * (found["ja"] + found.get("zh", 0)):
        found["ja"] += found.pop("zh", 0)
    if found:
        found[""] = len("".join(_LATIN.findall(part)))
    return found


def _add(counts: dict[str, int], more: dict[str, int]) -> None:
    for name, n in more.items():
        counts[name] = counts.get(name, 0) + n


def _most(counts: dict[str, int], default: str) -> str:
    return max(sorted(counts), key=counts.get) if counts else default


def languages_of(text: str, blocks: list[tuple[int, int, bool]], words: dict[str, tuple[str, ...]] = _FUNCTION_OF) -> list[str]:
    """The language of each block, whose statistics it uses: by script, for Latin by function words.

    All of the text is read.  A block that doesn't show its language (another one
    than the document's needs two function words and more than the document's has)
    has that of the document's blocks in its script.
    """
    others = "" if text.isascii() else "".join(c for c in set(text) if c > "\u036f")
    scripts = [x for x in _SCRIPT_FIND if x[1].search(others)] if others else []
    lowered = text.lower()
    if not scripts:
        # Where each word that is there speaks for the document's language, no block can show another one.
        there = Counter(filter(words.__contains__, lowered.split()))
        all_votes: dict[str, int] = {}
        for word, n in there.items():
            for language in words[word]:
                all_votes[language] = all_votes.get(language, 0) + n
        only = _most(all_votes, "latin")
        if all(only in words[word] for word in there):
            return [only] * len(blocks)
    if len(lowered) != len(text):
        lowered = ""  # places differ
    latin_votes: dict[str, int] = {}
    letters: dict[str, int] = {}
    each = []
    for start, end, _ in blocks:
        part = text[start:end]
        votes: dict[str, int] = {}
        for word in filter(words.__contains__, lowered[start:end].split() if lowered else part.lower().split()):
            for language in words[word]:
                votes[language] = votes.get(language, 0) + 1
        _add(latin_votes, votes)
        found = _letters(part, scripts) if scripts else {}
        _add(letters, found)
        if scripts and not found and (n := len("".join(_LATIN.findall(part)))):
            found = {"": n}
            _add(letters, found)
        each.append((found, votes))
    latin, main = _most(latin_votes, "latin"), _most(letters, "")
    out = []
    for found, votes in each:
        # A block without letters goes with the script of the document.
        if script := _most(found, main):
            out.append(script)
            continue
        best = _most(votes, latin)
        out.append(best if best == latin or (votes[best] >= 2 and votes[best] > votes.get(latin, 0)) else latin)
    return out


def blocks_of(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, heading)`` of headings, list items, turns and paragraphs."""
    blocks: list[list] = []
    open_block = in_list = False
    for found in _LINE.finditer(text):
        start, line = found.start(), found[0]
        if start == found.end():
            continue
        if not line.strip():
            open_block = in_list = False
            continue
        if _HEADING.match(line):
            blocks.append([start, found.end(), True])
            open_block = in_list = False
            continue
        number = _NUMBERED.match(line)
        item = bool(_BULLET.match(line)) or bool(number and (not open_block or in_list or number[1] == "1"))
        if item or not open_block or _TURN.match(line):
            blocks.append([start, found.end(), False])
            in_list = item
        else:
            blocks[-1][1] = found.end()
        open_block = True
    return [tuple(b) for b in blocks]


def _type(token: str) -> str:
    word = token.strip(_STRIP)
    for mark in "'’":
        if mark in word:
            word = word.rpartition(mark)[2] or word
    return word


@dataclass
class Model:
    """What was learned, by language; ``function_words`` has the languages of each word."""

    abbreviations: dict[str, set] = field(default_factory=dict)
    starters: dict[str, set] = field(default_factory=dict)
    after_number: dict[str, set] = field(default_factory=dict)
    function_words: dict[str, tuple[str, ...]] = field(default_factory=lambda: {word: tuple(langs) for word, langs in _FUNCTION_OF.items()})


_NONE: frozenset = frozenset()


def _read_token(token: str) -> tuple[str, bool, bool, bool]:
    """A token's type (numbers: ``##``), whether it ends in a period, is a number, surely ends a sentence."""
    bare = token.rstrip(_CLOSE)
    period = bare.endswith(".") and not bare.endswith("..")
    kind = _type(bare[:-1] if period else bare)
    number = bool(kind) and _NUMBER.fullmatch(kind) is not None
    return "##" if number else kind, period, number, (period and len(kind) > 3 and not number) or bare[-1:] in ("!", "?")


def _count(texts: pd.Series, profiles: dict[str, tuple[str, ...]] = _FUNCTION_OF) -> Counter:
    """Counts of ``(lang, kind, type)``: with period within (w) or at the end (f) of a block, without (o), after a break (s), after a number's period (n).

    Types keep their capitals but for (s) and (n): a title may be written as a unit is, but for its capital.
    Tokens are counted as they are written and read once each; only those that hold
    a mark are looked at in their place.
    """
    written: dict[str, Counter] = {}
    counts: Counter = Counter()
    known: dict[str, tuple] = {}

    def read(token: str) -> tuple[str, bool, bool, bool]:
        if token not in known:
            known[token] = _read_token(token)
        return known[token]

    for text in texts:
        if not text or not text.strip():
            continue
        blocks = blocks_of(text)
        for (start, end, heading), lang in zip(blocks, languages_of(text, blocks, profiles), strict=True):
            if heading or lang in ("zh", "ja", "th"):
                continue
            tally = written.setdefault(lang, Counter())
            tokens = text[start:end].split()
            tally.update(tokens)
            for i in [i for i, t in enumerate(tokens, 1) if "." in t or "!" in t or "?" in t]:
                kind, period, number, sure = read(tokens[i - 1])
                if not kind:
                    continue
                if i == len(tokens):
                    if period:
                        counts[lang, "f", kind] += 1
                        counts[lang, "w", kind] -= 1
                elif sure or (period and number):
                    follower = next((f for t in tokens[i:] if (f := read(t)[0])), None)
                    if follower and sure:
                        counts[lang, "s", follower.lower()] += 1
                    if follower and period and number:
                        counts[lang, "n", follower.lower()] += 1
    for lang, tally in written.items():
        for token, n in tally.items():
            if token.isalpha():  # as most are
                counts[lang, "o", token] += n
                continue
            kind, period, _, _ = read(token)
            if kind:
                counts[lang, "w" if period else "o", kind] += n
    return +counts


def _counted_with(profiles: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = _count(batch["text"], profiles)
            columns = {name: pd.Series([k[i] for k in counts], dtype=object) for i, name in enumerate(("lang", "kind", "type"))}
            yield pd.DataFrame(columns | {"n": pd.Series(list(counts.values()), dtype="int64")})

    return run


def _ratio(a: str, b: str, ab: str, n: str, p2: str) -> str:
    """Twice the log-likelihood ratio of "``b`` comes as often with ``a`` as everywhere" against ``p2``."""
    p1 = f"greatest(least({b} / {n}, 0.999999), 1e-9)"
    return f"2 * (({ab}) * ln({p2}) + ({a} - ({ab})) * ln(1 - {p2}) - ({ab}) * ln({p1}) - ({a} - ({ab})) * ln(1 - {p1}))"


def learned(documents: DataFrame, text: str = "text", lang: str | None = None, abbreviation_score: float = 0.3, starter_score: float = 30.0, collocation_score: float = 7.88, most_labelled: int = 5_000) -> DataFrame:
    """Statistics of all documents; see the module's text: ``lang, type, a, s, c``, what passes the tests.

    An abbreviation (a) is a short type that is written with a period far more often
    than chance and hardly ever ends a block (a blank line always ends a sentence).
    A starter (s) follows sentence ends far more often than chance; a collocation (c)
    follows the period of a number in most of its uses.  Abbreviations are told apart
    by their capitals where both spellings are in use, starters and collocations aren't.
    """
    profiles = function_words(documents, text, lang, most_labelled)
    return _tested(documents, text, profiles, abbreviation_score, starter_score, collocation_score).unionByName(profiles_as_rows(documents, profiles))


def _tested(documents: DataFrame, text: str, profiles: dict[str, tuple[str, ...]], abbreviation_score: float, starter_score: float, collocation_score: float) -> DataFrame:
    each = documents.select(F.col(f"`{text}`").alias("text")).where("text is not null").mapInPandas(_counted_with(profiles), "lang string, kind string, type string, n long")
    wide = each.groupBy("lang", "type").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in "wfosn"])
    wide = cut(wide)
    totals = wide.groupBy("lang").agg(F.sum(F.expr("w + f + o")).alias("all_n"), F.sum(F.expr("w + f")).alias("dots"), F.sum("f").alias("finals"), F.sum("s").alias("breaks"), F.sum("n").alias("numbers"))
    totals = F.broadcast(totals)  # one row for each language
    # The totals are those of all tokens; no test asks for a type that is only written without a period and begins nothing.
    dotted = wide.where("w + f > 0").join(totals, "lang")
    begun = wide.groupBy("lang", F.lower("type").alias("type")).agg(*[F.sum(c).alias(c) for c in "wfosn"]).where("s + n > 0").join(totals, "lang")
    bare = "greatest(length(replace(type, '.', '')), 1)"
    score = f"({_ratio('(w + f + o)', 'dots', 'w + f', 'all_n', '0.99')}) * exp(-{bare}) * (length(type) - length(replace(type, '.', '')) + 1) / pow({bare}, least(o, 50))"
    rarely_final = "(f = 0 or f / greatest(w + f, 1) < 0.25 * finals / greatest(dots, 1))"
    abbreviation = F.expr(f"w > 0 and type <> '##' and type rlike '\\\\p{{L}}' and {rarely_final} and {score} >= {abbreviation_score}")
    # Spark may compute the quotients before the tests in front of them.
    of_breaks, total = "s / greatest(breaks, 1)", "greatest(w + f + o, 1)"
    starter = F.expr(f"s > 0 and {of_breaks} > {total} / all_n and type <> '##' and {_ratio('breaks', total, 's', 'all_n', f'greatest(least({of_breaks}, 0.999999), 1e-9)')} >= {starter_score}")
    collocation = F.expr(f"n > 1 and type <> '##' and n / {total} >= 0.5 and {_ratio(total, 'numbers', 'n', 'all_n', f'greatest(least(n / {total}, 0.999999), 1e-9)')} >= {collocation_score}")
    no = F.lit(False)
    cased = dotted.where(abbreviation).select("lang", "type")
    # In small letters too, unless these are also written without a period, as a unit that looks like a title is.
    small = cased.select("lang", F.lower("type").alias("type")).distinct()
    used = wide.where("o > 0").select("lang", "type").join(small, ["lang", "type"], "left_semi")
    small = small.join(used, ["lang", "type"], "left_anti")
    abbreviations = cased.unionByName(small).distinct().select("lang", "type", F.lit(True).alias("a"), no.alias("s"), no.alias("c"))
    others = begun.select("lang", "type", no.alias("a"), F.coalesce(starter, no).alias("s"), F.coalesce(collocation, no).alias("c")).where("s or c")
    return abbreviations.unionByName(others)


def model_of(rows: pd.DataFrame) -> Model:
    """The model that rows of ``learned`` stand for."""
    model = Model()
    profiles: dict[str, list[str]] = {}
    for lang, kind, a, s, c in zip(rows["lang"], rows["type"], rows["a"], rows["s"], rows["c"], strict=True):
        if not (a or s or c):
            profiles.setdefault(kind, []).append(lang)
        for flag, table in ((a, model.abbreviations), (s, model.starters), (c, model.after_number)):
            if flag:
                table.setdefault(lang, set()).add(kind)
    model.function_words = {word: tuple(sorted(langs)) for word, langs in profiles.items()}
    return model


def learn(documents: DataFrame, text: str = "text", lang: str | None = None, most_kept: int = 1_000_000, **options) -> Model:
    """``learned`` as a model on the driver, to look at or to use on single texts; more than ``most_kept`` rows are an error."""
    rows = learned(documents, text, lang, **options).limit(most_kept + 1).toPandas()
    if len(rows) > most_kept:
        raise ValueError(f"more than {most_kept} types were learned; use find_sentences, which leaves them in the shared folder")
    return model_of(rows)


def function_words(documents: DataFrame, text: str = "text", lang: str | None = None, most_labelled: int = 5_000, least_documents: int = 20) -> dict[str, tuple[str, ...]]:
    """Frequent words that tell languages of the Latin script apart, with their languages, learned from labels.

    ``lang`` is a column of labels, of which some may be missing or wrong.  A label
    counts if ``least_documents`` of the sample have it and write mostly Latin.  Words
    are those that make up at least 1 of 300 of the words of a label; they speak for
    all labels of which they are at least a fifth of that part.  Languages of the fixed list without
    a label keep their words.  Without labels all are those of the fixed list.

    The sample is at most about ``most_labelled`` labelled documents, by a hash of the text.
    """
    fixed = {word: tuple(langs) for word, langs in _FUNCTION_OF.items()}
    if lang is None:
        return fixed
    labelled = documents.where(F.col(f"`{lang}`").isNotNull())
    rows = labelled.where(F.col(f"`{text}`").isNotNull()).select(F.lower(F.btrim(F.col(f"`{lang}`"))).alias("lang"), F.col(f"`{text}`").alias("text"))
    part = max(1, -(-labelled.count() // most_labelled))
    words = rows.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).mapInPandas(_profile_counts, "lang string, word string, docs long, n long")
    counts = cut(words.groupBy("lang", "word").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("word") == "", F.col("docs"))).alias("all_docs"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("all_n"), F.sum(F.when(F.col("word") != "", F.col("n"))).alias("latin"))
    known = totals.where((F.col("all_docs") >= least_documents) & (F.col("latin") >= 0.6 * F.col("all_n"))).select("lang", "latin")
    shares = counts.where("word <> ''").join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("latin")).where("share >= 1 / 1500")
    told = shares.withColumn("most", F.max("share").over(Window.partitionBy("word"))).where("most >= 1 / 300 and share >= 0.2 * most").select("lang", "word")
    labels = {r["lang"] for r in known.select("lang").collect()}  # a label has 20 documents of a bounded sample, a word 1 of 300 places of a label
    profiles: dict[str, set[str]] = {}
    for r in told.collect():
        profiles.setdefault(r["word"], set()).add(r["lang"])
    for word, langs in fixed.items():
        for own in langs:
            if own not in labels:
                profiles.setdefault(word, set()).add(own)
    return {word: tuple(sorted(langs)) for word, langs in profiles.items()}


def _profile_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, word, docs, n`` of the short words in small Latin letters; under the empty word all documents and words."""
    for batch in batches:
        counts: Counter = Counter()
        docs: Counter = Counter()
        for label, text in zip(batch["lang"], batch["text"], strict=True):
            tokens = text.lower().split()
            docs[label] += 1
            counts[label, ""] += len(tokens)
            counts.update((label, t) for t in tokens if len(t) <= 7 and _LATIN.fullmatch(t))
        yield pd.DataFrame([(lang, word, docs[lang] if word == "" else 0, n) for (lang, word), n in counts.items()], columns=["lang", "word", "docs", "n"]).astype({"lang": object, "word": object, "docs": "int64", "n": "int64"})


def profiles_as_rows(documents: DataFrame, profiles: dict[str, tuple[str, ...]]) -> DataFrame:
    """Profiles as rows of ``learned``: no flag is set."""
    rows = [(lang, word, False, False, False) for word, langs in profiles.items() for lang in langs]
    return documents.sparkSession.createDataFrame(rows, "lang string, type string, a boolean, s boolean, c boolean")


def _unclosed(text: str, start: int, end: int, limit: int) -> bool:
    """Whether a bracket or quotation opened in ``text[start:end]`` is closed only behind it, within the block."""
    part = text[start:end]
    if not _OPENED.search(part):
        return False
    if part.count('"') % 2 and 0 <= text.find('"', end, limit):
        return True
    return any(opener in part and part.rfind(opener) > part.rfind(closer) and 0 <= text.find(closer, end, limit) for opener, closer in _PAIRS.items())


def _after_closing(text: str, start: int, at: int, limit: int) -> int:
    """Where the closing marks, quotes and brackets behind a sentence's last mark end.

    Marks that open in one language and close in another count by what is open.
    """
    while at < limit:
        c = text[at]
        if c == '"':
            closes = text.count('"', start, at) % 2 == 1
        elif c == "“":
            closes = text.rfind("„", start, at) > text.rfind("“", start, at)
        elif c == "'":
            closes = at + 1 == limit or not text[at + 1].isalnum()
        elif c.isspace():
            closes = text[at + 1 : at + 2] == "»"
        else:
            closes = c in _CLOSING
        if not closes:
            break
        at += 1
    return at


def _is_end(text: str, start: int, m: re.Match, e: int, limit: int, lang: str, model: Model) -> bool:
    nxt = text[e]
    close, run = text[m.end() : e], m["run"]
    if run is None:  # a final particle
        return nxt.isspace() and not _unclosed(text, start, e, limit)
    ellipsis = "…" in run or ".." in run
    wide = run[-1] in "。！？｡"
    if wide and not ellipsis:
        if _unclosed(text, start, e, limit):
            return False
        if close and not nxt.isspace() and nxt.isalpha() and any(c in _QUOTES_CLOSE for c in close):
            if nxt == "と" or text.startswith("って", e):
                return False
            # A quotation that begins the sentence goes on with the words that say who speaks.
            head = start
            while head < e and (text[head].isspace() or text[head] in "-*+•0123456789.)[]:" or (text[head].isascii() and text[head].isalnum())):
                head += 1
            return text[head] not in _PAIRS or text[head] in "（("
        return True
    if not nxt.isspace():
        return False
    at = _BEFORE_WORD.match(text, e, limit).end()
    if at >= limit:
        return True
    first = text[at]
    if close and text[e:at + 1].strip()[:1] in ("—", "–"):
        return False
    if _unclosed(text, start, e, limit):
        return False
    lower = _ALNUM.match(text, at, limit)[0].islower()  # a word with a capital inside counts as capitalised
    before = m.start()
    cased = text[before - 1 : before].lower() != text[before - 1 : before].upper() if before > start else False
    if not cased and before > start and not text[before - 1].isalpha():
        cased = lang not in ("ko", "hi", "ar", "th", "ja", "zh")
    if ellipsis:
        return not (lower and (cased or close))
    if run[-1] != ".":
        return not (lower and close)
    if close:
        return not lower or not cased
    left = before
    if before > start and not text[before - 1].isspace():
        left -= len(text[start:before].rsplit(None, 1)[-1])
    word = _type(text[left:before])
    follower = _type(_TOKEN.match(text, at, limit)[0].rstrip(".!?…" + _CLOSE)).lower()
    starts = not lower and first.isalpha() and follower in model.starters.get(lang, _NONE)
    low = word.lower()
    if len(word) == 1 and word.isupper():
        return starts and at - e < 3 and text[left - 2 : left - 1] != "."
    abbreviations = model.abbreviations.get(lang, _NONE)
    if word in abbreviations or low in abbreviations or ("." in word and not any(c.isdigit() for c in word) and len(max(word.split("."), key=len)) <= 2):
        return starts
    if lower and cased:
        return False
    if _NUMBER.fullmatch(word) and follower in model.after_number.get(lang, _NONE):
        return False
    return True


def split_sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in order, without white space at their ends."""
    if not text or not text.strip():
        return []
    marks = _END_OR_FINAL if not text.isascii() and _THAI.search(text) else _END
    spans: list[tuple[int, int]] = []

    def add(start: int, end: int) -> None:
        part = text[start:end]
        start, end = end - len(part.lstrip()), start + len(part.rstrip())
        if start < end:
            spans.append((start, end))

    blocks = blocks_of(text)
    for (begin, end, heading), lang in zip(blocks, languages_of(text, blocks, model.function_words), strict=True):
        if heading:
            add(begin, end)
            continue
        limit = end
        while limit > begin and text[limit - 1].isspace():
            limit -= 1
        start = begin
        marker = _NUMBERED.match(text, begin, limit)
        at = marker.end() - 1 if marker else begin
        while m := marks.search(text, at, limit):
            at = _after_closing(text, start, m.end(), limit)
            if at >= limit:
                break
            if _is_end(text, start, m, at, limit, lang, model):
                add(start, at)
                start = at
        add(start, limit)
    return spans


_SPANS = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))


def _spans_by(model_of_worker):
    @F.pandas_udf(_SPANS)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_of_worker()
        for texts in batches:
            yield pd.Series([split_sentences(t, model) if t else [] for t in texts], dtype=object)

    return column


def sentence_spans(model: Model):
    """A column function: the spans of the sentences of a text (none for null)."""
    return _spans_by(lambda: model)


def find_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, lang: str | None = None) -> DataFrame:
    """``key, sentence, char_start, char_end`` of every sentence of every document.

    Positions count code points; ``sentence`` numbers them from 0.  Every visible
    character belongs to exactly one sentence.  Null, empty and blank texts give
    none; a document that is there twice gives its sentences twice.  Without
    ``model`` the statistics are those of ``documents``, and stay in the shared folder
    (``llm.blocks``); with none to learn from (no periods at all) every period counts
    by its surroundings alone.  ``lang`` is a column of labels, which may be missing
    or wrong, from which the words that tell languages apart are learned.
    """
    if model is None:
        # As one block: a type is there if it passes the tests of a language.
        path, _ = write_blocks(learned(documents, text, lang).withColumn("cost", F.lit(0)), "cost", 1)
        spans = _spans_by(lambda: read_block(path, 0, lambda rows: model_of(rows) if len(rows) else Model()))
    else:
        spans = sentence_spans(model)
    return documents.select(F.col(key), F.posexplode(spans(F.col(f"`{text}`"))).alias("sentence", "s")).select(key, "sentence", "s.char_start", "s.char_end")
