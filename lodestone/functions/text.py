"""Text functions of the memory index, all as Spark SQL expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the index understands it: ASCII and the Unicode spaces.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: What a text that isn't blank holds.
NOT_BLANK = SPACE.replace("[", "[^", 1)
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
_WORD = r"[0-9A-Za-z_]"

#: Patterns that mark a decision, and a request to remember.
DECISION = (r"\bdecided\b", r"\bwe (will|should|chose|picked|use)\b", r"\bgo with\b", r"\bfrom now on\b", "决定", "拍板", "选定", "以后默认", "今后", "统一约定")
REMEMBER = (r"\bremember (this|that)\b", r"\bdon't forget\b", "记住", "记下", "记一下", "写入记忆")
#: Names of public tools that raise the importance of a record.  A deployment adds those of its own projects.
ENTITIES = (r"content[- ]adapter", "flutter", "docker", "wsl")
#: Shapes of secrets.
SECRETS = (r"sk-[a-zA-Z0-9]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"-----BEGIN [A-Z ]+PRIVATE KEY-----", r"\bxox[abp]-[A-Za-z0-9-]{10,}\b")


def _ascii_bounds(pattern: str) -> str:
    """``\\b`` with ASCII words only, which is what the patterns mean next to other scripts."""
    bound = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return "(?i)" + pattern.replace(r"\b", bound)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def canonical(c: Column) -> Column:
    """Line ends as LF, no blanks at line ends, at most one blank line, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return trim_space(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def hashed_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 24 hex digits of the SHA-256 of the parts, joined by NUL; null counts as empty."""
    joined = F.concat_ws(chr(0), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def summary(text: Column, size: int = 200) -> Column:
    """The first line that is neither blank nor a heading, without its list marker."""
    lines = F.filter(F.split(text, r"\r?\n", -1), lambda x: ~x.rlike(HEADING) & x.rlike(NOT_BLANK))
    line = F.regexp_replace(F.regexp_replace(trim_space(F.try_element_at(lines, F.lit(1))), r"^[-*+]\s+", ""), r"^\d+\.\s+", "")
    return F.coalesce(F.left(line, F.lit(size)), F.lit("(empty section)"))


def first_date(title: Column, text: Column, fallback: Column) -> Column:
    """Midnight UTC of the first date-like string of the title, else of the text."""
    pattern = rf"(?<!{_WORD})(20\d{{2}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?!{_WORD})"
    build = lambda c: F.when(c.rlike(pattern), F.concat(F.regexp_extract(c, pattern, 1), F.lit("-"), F.lpad(F.regexp_extract(c, pattern, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(c, pattern, 3), 2, "0"), F.lit("T00:00:00.000Z")))
    return F.coalesce(build(title), build(text), fallback)


def round_half_up(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def _literal(pattern: str) -> str:
    """The longest wording that every match of a pattern holds, in lower case; empty where there is none."""
    outside = re.sub(r"\([^)]*\)|\[[^\]]*\]|\\.", "\x00", pattern) if "|" not in re.sub(r"\([^)]*\)", "", pattern) else ""
    return max(re.split(r"[\x00.^$*+?{}|]", re.sub(r".[*?{]", "\x00", outside)), key=len).lower()


def _matches(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns a text matches, in any case; a plain search for their wording goes before each."""
    found = F.lit(0)
    for p in patterns:
        found = found + F.when(F.contains(F.lower(c), F.lit(_literal(p))), c.rlike(_ascii_bounds(p)).cast("int")).otherwise(0)
    return found


def _dated(text: Column) -> Column:
    return text.rlike(rf"(?<!{_WORD})(20\d{{2}}|19\d{{2}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?!{_WORD})")


def importance_signals(text: Column, entities: Sequence[str] = ENTITIES) -> Column:
    """What the importance of a text is made of, in a fixed order."""
    named = _matches(text, entities)
    return F.array_compact(
        F.array(
            F.lit("baseline:0.40"),
            F.when(_matches(text, DECISION) > 0, "decision:+0.20"),
            F.when(_matches(text, REMEMBER) > 0, "remember:+0.25"),
            F.when(named > 0, F.format_string("entities(%d):+%.2f", named, F.least(F.lit(0.15), F.lit(0.05) * named))),
            F.when(_dated(text), "timestamp:+0.05"),
            F.when(F.length(text) < 80, "too_short:-0.20"),
        )
    )


def importance(text: Column, entities: Sequence[str] = ENTITIES) -> Column:
    """0.4, more for decisions, requests to remember, names and dates, less for very short text; within 0 and 1."""
    score = (
        F.lit(0.4)
        + F.when(_matches(text, DECISION) > 0, 0.2).otherwise(0.0)
        + F.when(_matches(text, REMEMBER) > 0, 0.25).otherwise(0.0)
        + F.least(F.lit(0.15), F.lit(0.05) * _matches(text, entities))
        + F.when(_dated(text), 0.05).otherwise(0.0)
        - F.when(F.length(text) < 80, 0.2).otherwise(0.0)
    )
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def has_secret(c: Column) -> Column:
    tests = F.lit(False)
    for p in SECRETS:
        tests = tests | c.rlike(p.replace(r"\b", rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"))
    return tests


def query_tokens(c: Column) -> Column:
    """Tokens of a question, of at least two characters; repeats stay."""
    return F.filter(F.split(c, "[\\s,.;:!?()'\"`，。；：！？（）]+"), lambda t: F.length(t) >= 2)


def _accent_pairs() -> tuple[str, str]:
    """Letters that decompose into a base and marks, and their bases, by rule."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _BASES = _accent_pairs()


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index: lower case, without accents, split at all but letters and digits."""
    low = F.lower(c)
    # Most texts are ASCII; only the others pay for the replacement of letters.
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, _ACCENTED, _BASES), r"\p{Mn}+", ""))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: F.length(t) > 0)


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.format_string("%s#L%d-L%d", path, start, end)).otherwise(path)
