"""Personal information in free text: detection, and keyed surrogates.

Detection is a set of shapes with cues.  Names in Latin letters rest on evidence of
the corpus: from a list of frequent given names and from titles Spark learns family
names, and from these further given names (``learn_names``).

Replacement gives every distinct entity one keyed surrogate of its own type, format,
script and (for names) gender; entities that differ get different surrogates, which
aren't entities of the corpus themselves, and mentions of one entity get the same one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.session import cut, written

KINDS = ("email", "phone", "id_number", "address", "name")

#: Given names by gender, in the languages that are handled.
GIVEN = {
    "f": "Alice Amina Ana Andrea Anna Anne Antonia Barbara Beatriz Camille Carla Carmen Catherine Chiara Christine Claire Clara Claudia Diana Elena Elisa Emilia Emily Emma Eva Fatima Francesca Gabriela Giulia Greta Hannah Helen Helena Ines Ingrid Irene Isabel Isabella Jana Jane Johanna Julia Karin Katharina Laura Lea Lena Lisa Louise Lucía Lucia Luisa Manon Maria María Marie Marta Martina Mary Mia Monica Nadia Natalia Nina Nora Olivia Paula Petra Rosa Sabine Sara Sarah Silvia Sofia Sofie Sonia Sophie Susanne Teresa Ursula Valentina Vera Victoria Zoe",
    "m": "Ahmed Alejandro Alexander Ali Andrés Andreas Anton Antonio Ben Bernard Carlos Charles Christian Daniel David Diego Eduardo Felix Fernando Francisco Frank Gabriel George Georg Hans Hassan Henri Henrik Henry Hugo Ibrahim Ivan Jack Jakob James Jan Javier Jean Jens Johann John Jonas Jorge José Joseph Juan Julian Karim Karl Klaus Lars Leon Louis Luca Lucas Luis Lukas Manuel Marc Marco Mark Martin Matteo Max Michael Miguel Mohammed Nicolas Noah Oliver Omar Oscar Otto Pablo Paul Pedro Peter Philipp Pierre Rafael Ricardo Robert Samuel Sebastian Sergio Simon Stefan Thomas Tom Tomás Victor Walter William Yusuf",
}
_GENDER = {name: g for g, names in GIVEN.items() for name in names.split()}
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿ"
_W = rf"[{_UP}{_LOW}]"
_FAMILY = rf"[{_UP}][{_LOW}]+(?:['’][{_UP}][{_LOW}]+)?(?:-[{_UP}][{_LOW}]+)*"

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+@/-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?(?:@| ?[(\[] ?(?:at|AT|arroba|arobase) ?[)\]] ?)"
    r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?(?:dot|DOT|punto|point|punkt) ?[)\]] ?)[A-Za-z0-9-]+)*(?:\.| ?[(\[] ?(?:dot|DOT|punto|point|punkt) ?[)\]] ?)[A-Za-z]{2,}(?![A-Za-z0-9@-])"
)
_EMAIL_HINT = re.compile(r"@|[(\[] ?(?:at|AT|arroba|arobase) ?[)\]]")

_PLACE = rf"[{_UP}]{_W}+(?:[- ](?:(?:de|del|la|an|der|am|im|sur|sous|le|les) )?[{_UP}]{_W}+){{0,2}}"
_ADDRESSES = [
    re.compile(
        rf"(?<![\w.,/])\d{{1,5}}[a-zA-Z]? (?:[NSEW]\. )?[{_UP}]{_W}+(?: [{_UP}]{_W}+)?? (?:Street|Avenue|Road|Lane|Boulevard|Court|Terrace|Drive|Place|Square|Crescent|Close|Way|Hill|Row|St\.?|(?:Blvd|Ave|Rd|Ln|Ct|Dr)(?:\.(?=[,.;]| [a-z(]))?)(?![\w-])"
        rf"(?:, (?:Apt|Flat|Unit|Suite|Apartment|Floor)\.? ?#?\w+)?(?:, [{_UP}]{_W}+(?: [{_UP}]{_W}+)?)?(?:,? (?:[A-Z]{{2}} )?\d{{5}}(?!\d))?"
    ),
    re.compile(rf"(?<!\w)(?:[{_UP}]{_W}*[{_LOW}](?:gasse|straße|strasse|str\.|weg|allee|platz|ufer|damm|ring)|[{_UP}]{_W}+(?:er|-) (?:Straße|Str\.|Weg|Allee|Platz|Ufer)) \d{{1,4}} ?[a-h]?(?!\w)(?:, \d{{5}} {_PLACE})?"),
    re.compile(
        rf"(?<!\w)(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía) ?(?:(?:de (?:la|las|los)|del|de) )?[{_UP}]{_W}+(?: (?:(?:de|del|la|las|los) )*[{_UP}]{_W}+)*,? \d{{1,4}}(?:,? \d{{1,2}}\.?[ºª](?: [A-Z])?)?(?:, \d{{5}} {_PLACE})?"
    ),
    re.compile(
        rf"(?<![\w.,/])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|chemin|quai|place|boulevard|allée|impasse|sentier|cours) (?:(?:des|de la|du|de|de l['’]|d['’]|aux?) ?)?[{_UP}]{_W}+(?:[- ](?:(?:des|de la|du|de) )?[{_UP}]{_W}+)*(?:, \d{{5}} {_PLACE})?"
    ),
    re.compile(rf"(?<!\w)(?:[{_UP}]{_W}*[{_LOW}](?:straat|laan|plein|gracht|kade) \d{{1,4}} ?[a-h]?(?!\w)(?:, \d{{4}} ?[A-Z]{{2}} {_PLACE})?|ul\. [{_UP}]\w+(?: [{_UP}]\w+)* \d{{1,4}}[a-z]?(?:/\d{{1,4}})?(?:, \d\d-\d{{3}} [{_UP}]\w+)?)"),
    re.compile(rf"(?<!\w)(?:[Rr]ua|[Tt]ravessa|[Ll]argo) (?:(?:d[aeo]s?|del|della) )?[{_UP}]{_W}+(?: (?:d[aeo]s? )?[{_UP}]{_W}+)*,? (?:n\.º )?\d{{1,4}}(?!\d)(?:, \d{{4,5}}-\d{{3}} {_PLACE})?"),
    # Without a postcode the Italian word for a street reads as a preposition of other languages.
    re.compile(rf"(?<!\w)(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Vv]icolo) (?:(?:d[aei]l?|della|dei|delle|degli) )?[{_UP}]{_W}+(?: [{_UP}]{_W}+)*,? \d{{1,4}}[a-z]?, \d{{5}} {_PLACE}"),
    re.compile(r"(?:(?:(?![在到于址送寄往住是至从])[一-鿿]){2,3}省)?(?:(?![在到于址送寄往住是至从])[一-鿿]){2,4}?市[一-鿿]{1,4}?[区县](?:[一-鿿]{1,4}镇)?[一-鿿]{1,6}?(?:路|街|大道|巷|道|弄)\d{1,5}号(?:\d+(?:号楼|栋|单元))*(?:\d+[室层])?"),
]
#: What a text holds if a pattern can match at all: first one for each of the addresses, then others.
_HINTS = {
    "english": "Street Avenue Road Lane Boulevard Court Terrace Drive Place Square Crescent Close Way Hill Row Blvd Ave St Rd Ln Ct Dr",
    "german": "gasse straße strasse str. weg allee platz ufer damm ring Straße Str. Weg Allee Platz Ufer",
    "spanish": "Calle C/ Avda. Av. Avenida Plaza Paseo Camino Ronda Travesía",
    "french": "rue avenue chemin quai place boulevard allée impasse sentier cours",
    "dutch": "straat laan plein gracht kade ul.",
    "portuguese": "Rua rua Travessa travessa Largo largo",
    "italian": "Via via Viale viale Piazza piazza Corso corso Vicolo vicolo",
    "chinese": "号",
    "id": "assport asaporte asseport SSN ID dentity dentidad orm Ausweis ausweis eisepass teuer-ID teuernummer ocumento DNI NIE NIF sociale 证件号 身份证 护照",
    "title": "Mr. Mrs. Ms. Dr. Prof. Sr. Sra. Dra. Hr. Fr. M. Mister Monsieur Madame Mme Mlle Herr Frau Señor Don Doña Signor Sir Lady Professor Doctor",
}


def _hint_automaton() -> ahocorasick.Automaton:
    kinds: dict[str, int] = {}
    for n, words in enumerate(_HINTS.values()):
        for word in words.split():
            kinds[word] = kinds.get(word, 0) | 1 << n
    automaton = ahocorasick.Automaton()
    for word, bits in kinds.items():
        automaton.add_word(word, bits)
    automaton.make_automaton()
    return automaton


_HINT_OF = _hint_automaton()
_ALL_HINTS = (1 << len(_HINTS)) - 1


def hints_of(text: str) -> set[str]:
    """The kinds of patterns that can match in a text, of those that have hints."""
    bits = 0
    for _, more in _HINT_OF.iter(text):
        bits |= more
        if bits == _ALL_HINTS:
            break
    return {kind for n, kind in enumerate(_HINTS) if bits >> n & 1}

_CLUSTER = re.compile(r"(?a)(?<![\w@.+/-])[+(]?\d[\d ()./-]{5,22}\d(?![\d@]|[.,]\d|-\w)")
_PHONES = [
    re.compile(p)
    for p in (
        r"\+\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,6}",
        r"00[1-9]\d(?=.*[ /-])(?:[ ./-]?\(?\d{1,8}\)?){1,5}",
        r"(?:1[ -])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}",
        r"0\d{4} \d{6}|0\d{3} \d{3} \d{4}|\(0\d{2,5}\) ?\d{3,8}(?:[ -]\d{1,4}){0,2}|0\d{1,5}/\d{3,8}(?:[ -]\d{1,4}){0,2}|0\d{2,3}-\d{7,8}|0\d{2,4} \d{5,8}(?:[ -]\d{1,4})?|0[2-8]\d{8}",
        r"0[1-9](?:[ .]\d\d){4}",
        r"[679]\d\d(?: \d\d){3}|[679]\d\d \d{3} \d{3}",
        r"1[3-9]\d{9}|1[3-9]\d-\d{4}-\d{4}|1[3-9]\d \d{4} \d{4}",
    )
]
#: Nine digits without separators are a phone number only after a word that says so.
_BARE, _BARE_CUE = re.compile(r"[5-9]\d{8}"), re.compile(r"(?:\bal|\bau|[Tt]el\.?|[Pp]hone|[Tt]eléfono|[Mm]óvil|[Nn]úmero|[Tt]elefon|[Hh]andy|[Tt]éléphone|\bunter|\bon|\bat|[Cc]all):? $")
_ID_DIGITS = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{17}|[12] \d\d \d\d \d[\dAB] \d{3} \d{3}(?: \d\d)?|\d{2} \d{3} \d{3} \d{3}")
_ID_SHAPES = re.compile(
    r"(?a)(?<![\w.@/-])(?:\d{17}[\dXx]|[A-CEGHJ-PQ-Z][A-NP-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z])(?![\w@])|(?<![\w.@/-])(?:\d{3}[- ]\d{2}[- ]\d{4})(?![\w@-])"
)
_ID_CUED = re.compile(
    r"(?a)(?:[Pp]assport|SSN|National ID|[Ii]dentity|ID|[Ff]orm|Ausweisnummer|Ausweis|Personalausweis|Reisepass|Steuer-ID|Steuernummer|identidad|Documento|DNI|NIE|NIF|[Pp]asaporte|sociale|[Pp]asseport|证件号|身份证号|身份证|护照)"
    r"(?:码|号|是|为|no\.?|n°|number|card|Nr\.?|[：:#(（ ])*([A-Z0-9](?:[A-Z0-9]{6,16}|[A-Z0-9]*(?:[ -][A-Z0-9]{1,4}){1,7}))(?![\w])"
)

_NAME = re.compile(rf"(?<![\w@.+/-])([{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)((?: [{_UP}]\.){{0,2}}) ({_FAMILY})(?![\w@]|\.\w)")
_REVERSED = re.compile(rf"(?<![\w@.+/-])([{_UP}]{{3,}}(?:['’-][{_UP}]{{2,}})*), ([{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)((?: [{_UP}]\.){{0,2}})(?![\w@])")
_TITLED = re.compile(
    rf"(?:(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Dra|Hr|Fr|M)\.|(?<!\w)(?:Mister|Monsieur|Madame|Mme|Mlle|Herrn?|Frau|Señora?|Don|Doña|Signora?|Sir|Lady|Professor|Doctor)) ((?:{_FAMILY} )?(?:[{_UP}]\. )*{_FAMILY})(?![\w@]|\.\w)"
)
#: Capitalised words in a row, each pair of neighbours.
_PAIR = re.compile(rf"(?<![\w@.+/-])([{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)(?: [{_UP}]\.){{0,2}} (?=({_FAMILY})(?![\w@]|\.\w))")
#: Articles and the like, which stand before common nouns and hardly ever before names.
_ARTICLES = frozenset(
    word
    for article in "the a an this that each our its der die das den dem des ein eine einen einem einer eines kein keine keinen unser unsere unseren ihr ihre le la les los las el un una une des du notre ce cette este esta ese esa".split()
    for word in (article, article.capitalize())
)
_CYRILLIC_NAME = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+(?:ич|ич[аеу]|ичем|вн[аеуы]|вной))? [А-ЯЁ][а-яё]+(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ым|е|ой)?|(?:ск|цк)(?:ий|ая|ого|ой|ому|им|ую)|енко|чук)(?!\w)")
_CYRILLIC_HINT, _HONORIFIC_HINT = re.compile("[А-ЯЁ]"), re.compile("[さ様殿씨님]")
#: Every identity number of a known shape has so many digits close together.
_SOME_DIGITS = re.compile(r"(?a)\d[\d -]{4}")
_HONORIFIC_NAME = re.compile(r"((?:[一-鿿]{1,3}[ \u3000])?[一-鿿]{1,4}|[ァ-ヴー]{2,10})(?=さん|さま|様|殿)|(?<![가-힣])([가-힣]{2,4})(?= ?(?:씨|님)(?![가-힣]))")
_HAN_NAME = r"((?:司徒|亓官|欧阳|上官|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐|夏侯|司马|端木|百里|[一-鿿])[一-鿿]{1,2})"
_HAN = [
    re.compile(p, re.MULTILINE)
    for p in (
        rf"(?:联系人|收件人|负责人|姓名|寄件人|经办人|客户|用户)[：: ]?{_HAN_NAME}(?=[，。；、,;（(\s]|的|住|电话|手机|$)",
        rf"(?:由|请|找|和|跟)(?:(?!由){_HAN_NAME})(?:跟进|负责|处理|确认|接手|联系|签收)",
        rf"(?:^|(?<=[。；，、：\s>|*-])){_HAN_NAME}(?:的(?:手机|电话|邮箱|号码|地址|住址)|(?:先生|女士|老师)|（证件号)",
    )
]
_HAN_HINT = re.compile(r"联系人|收件人|负责人|姓名|寄件人|经办人|客户|用户|跟进|负责|处理|确认|接手|联系|签收|的手机|的电话|的邮箱|的号码|的地址|的住址|先生|女士|老师|证件号")


def find_entities(text: str, given: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all entities of a text, in order, without overlap.

    ``given`` are given names beside those of the list.
    """
    taken: list[tuple[int, int]] = []
    found: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if start < end and not any(start < b and a < end for a, b in taken):
            taken.append((start, end))
            found.append((kind, start, end))

    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            add("email", m.start(), m.end())
    hints = hints_of(text)
    for hint, pattern in zip(_HINTS, _ADDRESSES):  # noqa: B905
        if hint in hints:
            for m in pattern.finditer(text):
                add("address", m.start(), m.end())
    if _SOME_DIGITS.search(text):
        for m in _ID_SHAPES.finditer(text):
            add("id_number", m.start(), m.end())
    if "id" in hints:
        for m in _ID_CUED.finditer(text):
            if sum(c.isdigit() for c in m[1]) >= 5:
                add("id_number", m.start(1), m.end(1))
    for m in _CLUSTER.finditer(text):
        start, end = m.span()
        if text[start] == "(" and ")" not in m[0]:
            start += 1
        digits = text[start:end]
        # A bracketed area code says enough for a short number.
        least = 8 if digits.startswith("(0") else 9
        if _ID_DIGITS.fullmatch(digits):
            add("id_number", start, end)
        elif least <= sum(c.isdigit() for c in digits) <= 16 and (any(p.fullmatch(digits) for p in _PHONES) or (_BARE.fullmatch(digits) and _BARE_CUE.search(text, max(0, start - 12), start))):
            add("phone", start, end)
    at = 0
    while m := _NAME.search(text, at):
        known = m[1] in _GENDER or m[1] in given or m[1].split("-")[0] in _GENDER
        if known:
            add("name", m.start(), m.end())
        at = m.end() if known else m.end(1)  # the second word may be the given name
    for m in _REVERSED.finditer(text):
        add("name", m.start(), m.end())
    if "title" in hints:
        for m in _TITLED.finditer(text):
            add("name", m.start(1), m.end(1))
    if not text.isascii():
        if _HAN_HINT.search(text):
            for pattern in _HAN:
                for m in pattern.finditer(text):
                    add("name", m.start(1), m.end(1))
        for hint, pattern in ((_CYRILLIC_HINT, _CYRILLIC_NAME), (_HONORIFIC_HINT, _HONORIFIC_NAME)):
            if hint.search(text):
                for m in pattern.finditer(text):
                    add("name", m.start(), m.end())
    return sorted(found, key=lambda x: x[1])


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of ``(kind, word, other)``: pairs, words behind titles, words with a capital, in small letters, behind articles."""
    for batch in batches:
        pairs: Counter = Counter()
        titles: Counter = Counter()
        behind: Counter = Counter()
        words: Counter = Counter()
        for text in batch["text"]:
            if not text:
                continue
            tokens = text.split()
            words.update(tokens)
            behind.update([b for a, b in zip(tokens, tokens[1:]) if a in _ARTICLES])  # noqa: B905
            pairs.update(_PAIR.findall(text))
            if "title" in hints_of(text):
                titles.update([name.rpartition(" ")[2] for name in _TITLED.findall(text)])
        counts: Counter = Counter({("pair", a, b): n for (a, b), n in pairs.items()})
        counts.update({("title", word, ""): n for word, n in titles.items()})
        for word, n in words.items():
            word = word.strip(_MARKS)
            if word.translate(_INSIDE).isalpha():
                kind = "capital" if word[0].isupper() and not word.isupper() else "small"
                counts[kind, word[0].upper() + word[1:], ""] += n
        for word, n in behind.items():
            word = word.strip(_MARKS)
            if word[:1].isupper():
                counts["article", word, ""] += n
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "word", "other", "n"]).astype({"kind": object, "word": object, "other": object, "n": "int64"})


_MARKS = "\"'“”‘’„«»()[]{}<>.,;:!?…*_|`。，；：！？（）"


#: Marks within names.
_INSIDE = str.maketrans("", "", "-'’")
#: Titles, which stand before family names as given names do.
_TITLE_WORDS = "Mr Mrs Ms Dr Prof Sr Sra Dra Hr Fr Mister Monsieur Madame Mme Mlle Herr Herrn Frau Señor Señora Don Doña Signor Signora Sir Lady Professor Doctor".split()


def learn_names(texts: DataFrame, text: str = "text", least_given: int = 2) -> DataFrame:
    """Given names that the texts show beside those of the list: column ``word``.

    A *family name* stands behind ``least_given`` different listed given names, or behind a
    title.  A *given name* stands right before a family name.  Either must hardly be
    written in small letters or behind an article (each in less than 1 of 20 uses),
    which common nouns and words that begin sentences are.

    All texts are counted, in one pass; counts are combined in the map tasks.
    """
    each = texts.select(F.col(f"`{text}`").alias("text")).mapInPandas(_evidence, "kind string, word string, other string, n long")
    counts = cut(each.groupBy("kind", "word", "other").agg(F.sum("n").alias("n")))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    words = counts.where("kind <> 'pair'").groupBy("word").agg(of("capital").alias("capital"), of("small", "article").alias("common"), of("title").alias("title"))
    proper = words.where("title > 0 or capital > 0").where("20 * common < capital + title")
    listed = F.col("word").isin(*_GENDER)
    pairs = counts.where("kind = 'pair'").select("word", F.col("other").alias("family"), "n")
    behind = pairs.where(listed).groupBy("family").agg(F.count(F.lit(1)).alias("n_given"))
    ends = proper.select(F.col("word").alias("family"), "title")
    families = ends.hint("merge").join(behind.hint("merge"), "family", "left").where((F.col("title") > 0) | (F.col("n_given") >= least_given)).select("family")
    before = pairs.where(~listed & ~F.col("word").isin(*_TITLE_WORDS)).hint("merge").join(families.hint("merge"), "family").select("word").distinct()
    return before.hint("merge").join(proper.select("word").hint("merge"), "word", "left_semi")


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("entity", T.StringType())]))


def entity_spans(given: frozenset[str] | set[str] = frozenset()):
    """A column function: all entities of a text with their places (code points) and wording; none for null."""
    given = frozenset(given)

    @F.pandas_udf(_SPANS)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[(k, a, b, t[a:b]) for k, a, b in find_entities(t, given)] if t else [] for t in texts], dtype=object)

    return column


@F.pandas_udf(_SPANS)
def _spans_with(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, names in batches:
        yield pd.Series([[(k, a, b, t[a:b]) for k, a, b in find_entities(t, set(own) if own is not None else set())] if t else [] for t, own in zip(texts, names, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _first_words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({a for a, _ in _PAIR.findall(t)}) if t else [] for t in texts], dtype=object)


def with_entities(rows: DataFrame, text: str = "text", names: DataFrame | None = None, most_sent: int = 200_000) -> DataFrame:
    """``rows`` with ``_spans``, the entities of each text.

    ``names`` (column ``word``) are given names beside those of the list; without it
    they are learned from ``rows``.  Up to ``most_sent`` of them go to every task.
    Beyond that each text is joined with those names that it holds, and the result is
    the same.
    """
    names = cut(learn_names(rows, text) if names is None else names.select("word").distinct())
    known = [r["word"] for r in names.limit(most_sent + 1).collect()]
    if len(known) <= most_sent:
        return rows.withColumn("_spans", entity_spans(known)(F.col(f"`{text}`")))
    based = rows.withColumn("_text", F.col(f"`{text}`"))
    each = based.where("_text is not null").select("_text").distinct().select("_text", F.explode(_first_words("_text")).alias("word"))
    own = each.hint("merge").join(names.hint("merge"), "word").groupBy("_text").agg(F.collect_set("word").alias("_own"))  # names of one text
    return based.hint("merge").join(own.hint("merge"), "_text", "left").withColumn("_spans", _spans_with("_text", "_own")).drop("_text", "_own")


def find_personal_data(rows: DataFrame, key: str = "chunk_id", text: str = "text", names: DataFrame | None = None, most_sent: int = 200_000) -> DataFrame:
    """``key, kind, char_start, char_end, entity`` of every entity of every row.

    Positions count code points in the stored text.  Null and empty texts give
    nothing; the same row twice gives its entities once.  ``names`` and ``most_sent``
    as in ``with_entities``.
    """
    base = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))
    each = with_entities(base, "_body", names, most_sent).select("_key", F.explode("_spans").alias("e"))
    return each.select(F.col("_key").alias(key), "e.kind", "e.char_start", "e.char_end", "e.entity").distinct()


def canonical_entity(kind: str, entity: str) -> str:
    """What is the same for all mentions of one entity."""
    if kind == "name":
        if m := _REVERSED.fullmatch(entity):
            entity = f"{m[2]} {m[1]}"
        return re.sub(rf" [{_UP}]\.", "", entity).casefold()
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", entity)).casefold()
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Za-z+]", "", entity).upper()
    if kind == "family":
        return entity.casefold()
    return " ".join(entity.split()).casefold()


class _Stream:
    """Numbers that follow from a key."""

    def __init__(self, secret: str, *parts: str) -> None:
        self.seed, self.n, self.left = hmac.new(secret.encode(), "\x00".join(parts).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left, self.n = hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), self.n + 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


_SYLLABLES = "bar bel bor dan del dor fal fen gar hal har kel lan lor mar mel nor pel ran rin sel sor tal ten var vel wan wen".split()
#: Frequent Chinese and Korean family names, and characters of given names.
_HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_COMPOUND = "欧阳 上官 诸葛 皇甫 尉迟 公孙 慕容 令狐 夏侯 司马 司徒 端木 东方 百里 亓官".split()
_HAN_GIVEN = "安宁景明思远嘉和书雅文清子涵一诺若溪云舒伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛超霞平刚桂兰玉萍红鹏辉建国志华宇浩轩梓怡佳琪欣妍雨泽睿博俊晨曦诗琳晓彤天翔少峰海燕春梅冬雪庆荣德福光耀振兴永康世昌立新正义忠诚朝阳长青小龙家豪美玲慧珍凤仙月娥爱莲淑贞惠如意"
_HAN_COMMON: list[str] = []
_HANGUL_FAMILY, _HANGUL_GIVEN = "김이박최정강조윤장임한오서신권황안송류홍", "민서준지우현수영진호성은하윤도예채아라나연주희경선미정혜원태훈석재"
_CYRILLIC = str.maketrans("abdefghklmnoprstvwi", "абдефгхклмнопрствви")


def _han_common() -> list[str]:
    """The characters of the first level of GB 2312, by its rows and cells."""
    if not _HAN_COMMON:
        _HAN_COMMON.extend(c for row in range(0xB0, 0xD8) for cell in range(0xA1, 0xFF) if (c := bytes((row, cell)).decode("gb2312", "ignore")))
    return _HAN_COMMON


def script_of(text: str) -> str:
    """The script of a name or address: of its first letter outside of Latin, else Latin."""
    for c in text:
        if "一" <= c <= "鿿":
            return "han"
        if "가" <= c <= "힣":
            return "hangul"
        if "ァ" <= c <= "ヿ":
            return "kana"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def family_of(canonical: str) -> str | None:
    """The family name of a canonical name in an alphabet, which all its bearers share; None in other scripts."""
    return canonical.rpartition(" ")[2] if script_of(canonical) in ("latin", "cyrillic") else None


#: Words of addresses that say what kind of place it is, or join others.
_KEPT_WORDS = frozenset(
    "street avenue road lane boulevard court terrace drive place square crescent close way hill row blvd ave apt flat unit suite apartment floor "
    "strasse str weg allee platz ufer damm ring der rue chemin quai allée impasse sentier cours bis ter quater des aux sur sous les "
    "calle avda avenida plaza paseo camino ronda travesía del las los".split()
)
_STREET = re.compile(r"[^\W\d_]+?(gasse|strasse|str|weg|allee|platz|ufer|damm|ring)")
_LETTERS = re.compile(r"[^\W\d_]+")
_AT, _DOT = re.compile(r" ?[(\[] ?(?:at|arroba|arobase) ?[)\]] ?", re.IGNORECASE), re.compile(r" ?[(\[] ?(?:dot|punto|point|punkt) ?[)\]] ?", re.IGNORECASE)


def surrogate(kind: str, canonical: str, secret: str, attempt: int = 0, family: str | None = None) -> str:
    """A replacement of the same kind, made from the key and the entity alone.

    Names keep gender, script and length; ``family`` is the replacement of the
    family name (kind ``family``), which is the same alone and behind all given names.
    Numbers keep their length and letters, addresses their kind of street, layout and
    script; domains are reserved ones.  ``attempt`` gives another one, of a larger choice.
    """
    s = _Stream(secret, kind, canonical, str(attempt))
    pick = lambda pool, s=s: pool[s.below(len(pool))]
    word = lambda n: "".join(pick(_SYLLABLES) for _ in range(n))
    han = lambda n, pool=_HAN_GIVEN: "".join(pick(pool) for _ in range(n))
    script = script_of(canonical)
    if kind == "family":
        made = word(3 + min(attempt, 3)).capitalize()
        return made.lower().translate(_CYRILLIC).capitalize() if script == "cyrillic" else made
    if kind == "name":
        if script == "han":
            bare = canonical.replace(" ", "")
            compound = bare[:2] in _HAN_COMPOUND
            own = _Stream(secret, "han family", bare[: 1 + compound])
            return pick(_HAN_COMPOUND if compound else _HAN_FAMILY, own) + han(max(1, len(bare) - 1 - compound), _HAN_GIVEN if attempt < 2 else _han_common())
        if script == "hangul":
            return pick(_HANGUL_FAMILY, _Stream(secret, "hangul family", canonical[:1])) + "".join(pick(_HANGUL_GIVEN) if attempt < 2 else chr(0xAC00 + s.below(11172)) for _ in range(max(1, len(canonical) - 1)))
        if script == "kana":
            return "".join(chr(0x30AB + s.below(60)) for _ in range(max(2, len(canonical))))
        given = canonical.rpartition(" ")[0]
        family = surrogate("family", family_of(canonical), secret) if family is None else family
        if not given:
            return family
        if script == "cyrillic":
            return f"{word(2 + min(attempt, 3)).translate(_CYRILLIC).capitalize()} {family}"
        pool = GIVEN[_GENDER.get(given.split()[0].split("-")[0].capitalize(), "f" if s.below(2) else "m")].split()
        return f"{'-'.join(pick(pool) for _ in range(1 + min(attempt, 3)))} {family}"
    if kind == "email":
        return f"{word(3)}{s.below(10 ** (3 + attempt))}@example.org"
    change = lambda m: str(s.below(10)) if m[0].isdigit() else "ABCDEFGHJKLMNPQRSTUVWXYZ"[s.below(24)]
    if kind == "phone":
        keep = 3 if canonical.startswith("+") else 1
        return canonical[:keep] + re.sub(r"\d", change, canonical[keep:])
    if kind == "id_number":
        return re.sub(r"[0-9A-Z]", change, canonical)
    if script == "han":
        return f"{han(2)}市{han(2)}区{han(2 + min(attempt, 3))}路{1 + s.below(999)}号"

    def place(m: re.Match) -> str:
        if len(m[0]) < 3 or m[0] in _KEPT_WORDS:
            return m[0]
        return word(2).capitalize() + street[1] if (street := _STREET.fullmatch(m[0])) else word(3).capitalize()

    return re.sub(r"\d", lambda m: str(1 + s.below(9)), _LETTERS.sub(place, canonical))


def as_mentioned(kind: str, entity: str, by: str) -> str:
    """A surrogate in the layout of one mention: its separators, spelt-out signs and capitals.

    Names read the same in all mentions, so that a reader sees who is the same.
    """
    if kind in ("phone", "id_number"):
        left = iter(by)
        shown = [(n.lower() if c.islower() else n) if re.match(r"[0-9A-Za-z+]", c) and (n := next(left, None)) else c for c in entity]
        return "".join(shown) + "".join(left)
    if kind == "email":
        at, dot = _AT.search(entity), _DOT.search(entity)
        by = by.replace(".", dot[0]) if dot else by
        return by.replace("@", at[0]) if at else by
    if kind == "address":
        words = iter(_LETTERS.findall(entity))
        return _LETTERS.sub(lambda m: w if (w := next(words, "")).casefold() == m[0] else m[0], by)
    return by


def _surrogate_column(secret: str):
    @F.pandas_udf(T.StringType())
    def column(kinds: pd.Series, entities: pd.Series, attempts: pd.Series, families: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, secret, int(a), f) for k, e, a, f in zip(kinds, entities, attempts, families, strict=True)], dtype=object)

    return column


@F.pandas_udf(T.StringType())
def _family_column(names: pd.Series) -> pd.Series:
    return pd.Series([family_of(n) for n in names], dtype=object)


@F.pandas_udf(T.StringType())
def _as_mentioned_column(kinds: pd.Series, entities: pd.Series, surrogates: pd.Series) -> pd.Series:
    return pd.Series([as_mentioned(k, e, b) for k, e, b in zip(kinds, entities, surrogates, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _canonical_column(kinds: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([canonical_entity(k, e) for k, e in zip(kinds, entities, strict=True)], dtype=object)


def _distinct_surrogates(entities: DataFrame, real: DataFrame, secret: str, rounds: int) -> DataFrame:
    """``kind, canonical, surrogate`` for ``kind, canonical, family``; surrogates differ in their canonical form and aren't in ``real``."""
    make = _surrogate_column(secret)
    taken = real.select("kind", F.col("canonical").alias("form"), F.lit(True).alias("_real"))
    by_form = Window.partitionBy("kind", "form").orderBy("attempt", "canonical")

    def drawn(table: DataFrame) -> DataFrame:
        each = table.withColumn("surrogate", make("kind", "canonical", "attempt", "family")).withColumn("form", _canonical_column("kind", "surrogate"))
        ranked = each.hint("merge").join(taken.hint("merge"), ["kind", "form"], "left").withColumn("_rank", F.row_number().over(by_form))
        return ranked.withColumn("_again", F.when(F.col("_real"), F.col("_rank")).otherwise(F.col("_rank") - 1))

    table = entities.select("kind", "canonical", "family").distinct().withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        table = cut(drawn(table).select("kind", "canonical", "family", (F.col("attempt") + F.col("_again")).alias("attempt")))
    return drawn(table).select("kind", "canonical", F.when(F.col("_again") > 0, F.concat_ws("-", "surrogate", F.col("_again") + 1)).otherwise(F.col("surrogate")).alias("surrogate"))


def assign_surrogates(entities: DataFrame, secret: str, rounds: int = 5) -> DataFrame:
    """``kind, canonical, surrogate``, one row for each entity (``kind, canonical``).

    Surrogates are distinct within a kind, and none is an entity of the same kind
    itself.  Family names get theirs first, so that those who share one share it
    afterwards, and no others.  Entities that meet on one surrogate are told apart:
    the first in order keeps it, the others draw again, from a larger choice; after
    ``rounds`` rounds those that still meet carry their rank as a suffix, so
    distinctness doesn't depend on luck.
    """
    real = cut(entities.select("kind", "canonical").distinct().withColumn("family", F.when(F.col("kind") == "name", _family_column("canonical"))))
    families = real.where("family is not null").select(F.lit("family").alias("kind"), F.col("family").alias("canonical"), F.lit(None).cast("string").alias("family")).distinct()
    replaced = _distinct_surrogates(families, families, secret, rounds).select(F.col("canonical").alias("family"), F.col("surrogate").alias("_by"))
    named = real.hint("merge").join(replaced.hint("merge"), "family", "left").select("kind", "canonical", F.col("_by").alias("family"))
    return _distinct_surrogates(named, real, secret, rounds)


@F.pandas_udf(T.StringType())
def _replace(texts: pd.Series, edits: pd.Series) -> pd.Series:
    out = []
    for text, changes in zip(texts, edits, strict=True):
        if text is None:
            out.append(None)
            continue
        for change in sorted(changes, key=lambda c: -c["char_start"]):
            text = text[: change["char_start"]] + change["by"] + text[change["char_end"] :]
        out.append(text)
    return pd.Series(out, dtype=object)


def redact(rows: DataFrame, secret: str, key: str = "chunk_id", text: str = "text", placeholders: bool = False, names: DataFrame | None = None, most_sent: int = 200_000) -> DataFrame:
    """``rows`` with ``redacted``: the text with every entity replaced, all else as it was.

    With ``placeholders`` an entity becomes ``[EMAIL]``, ``[PHONE]`` and so on, else
    its surrogate.  Rows without entities, null and empty texts stay as they are;
    all rows and columns are kept (an old ``redacted`` is replaced).  Entities are
    looked for once; what was found is kept with a 128-bit hash of its text, once for
    each distinct text, and joined by that.  ``names``, ``most_sent``: see ``with_entities``.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "redacted"]
    body = F.col(f"`{text}`")
    hashes = [F.xxhash64(body).alias("_h1"), F.xxhash64(F.lit(7), body).alias("_h2")]
    found = with_entities(rows.where(body.isNotNull()).select(body.alias("_body"), *hashes), "_body", names, most_sent).where(F.size("_spans") > 0)
    touched = written(found.select("_h1", "_h2", "_spans")).dropDuplicates(["_h1", "_h2"])
    spans = touched.select("_h1", "_h2", F.explode("_spans").alias("e")).select("_h1", "_h2", "e.*")
    if placeholders:
        edits = spans.withColumn("by", F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    else:
        spans = written(spans.withColumn("canonical", _canonical_column("kind", "entity")))
        given = spans.hint("merge").join(assign_surrogates(spans, secret).hint("merge"), ["kind", "canonical"])
        edits = given.withColumn("by", _as_mentioned_column("kind", "entity", "surrogate"))
    done = edits.groupBy("_h1", "_h2").agg(F.collect_list(F.struct("char_start", "char_end", "by")).alias("_edits"))  # of one text
    joined = rows.select(*kept, *hashes).hint("merge").join(done.hint("merge"), ["_h1", "_h2"], "left")
    edited = F.when(F.col("_edits").isNotNull(), _replace(F.when(F.col("_edits").isNotNull(), body), F.coalesce("_edits", F.array().cast(done.schema["_edits"].dataType))))
    return joined.select(*kept, F.coalesce(edited, body).alias("redacted"))
