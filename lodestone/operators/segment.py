"""Lines, sections, paragraphs and chunks of markdown.

Splitting is one ``split`` and array functions within a row: a text is never
exploded into lines and gathered again, so none of these needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import HEADING, NOT_BLANK, trim_space


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it, also in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _each(rows: DataFrame, key: str, text: str, array: Column, number: str, item: str) -> DataFrame:
    """``key, number, item``: the items of ``array`` for each row.

    The outer form of the generator, with its filter behind it: in front of the other
    Spark infers filters on the array, which would compute it three times.
    """
    each = rows.where(F.col(text).isNotNull()).select(key, F.posexplode_outer(array).alias(number, item))
    return each.where(F.col(number).isNotNull())


def _islands(lines: Column, starts) -> Column:
    """Runs of lines, numbered from 1: ``array<struct<start, end, text, head>>``; ``starts(line)`` says where one begins.

    Only where runs begin is searched for; a run is a slice, so a text of any length is read once.
    """

    def runs(ls: Column, at: Column) -> Column:
        def run(first: Column, k: Column) -> Column:
            last = F.coalesce(F.get(at, k + 1) - 1, F.size(ls))
            return F.struct(first.alias("start"), last.alias("end"), F.array_join(F.slice(ls, first, last - first + 1), "\n").alias("text"), F.element_at(ls, first).alias("head"))

        return F.transform(at, run)

    begins = lambda ls: F.array_compact(F.transform(ls, lambda x, i: F.when((i == 0) | starts(x), i + 1)))
    return _let(lines, lambda ls: _let(begins(ls), lambda at: runs(ls, at)))


def lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, n, line``: the lines of each text, numbered from 1; trailing empty ones stay."""
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("n", "line")).select(key, (F.col("n") + 1).alias("n"), "line")


def headings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, n, level, title`` of every ATX heading."""
    found = lines(rows, key, text).where(F.col("line").rlike(HEADING))
    return found.select(key, "n", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))


def sections(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section, title, line_start, line_end, text``: one section for each level-2 heading.

    What comes before the first of them is a section titled by a level-1 heading on
    line 1, else ``(top)``.  Blank sections are left out; ``section`` counts those kept.
    """
    level_2 = r"^##\s+(.+?)\s*#*\s*$"
    groups = _islands(F.split(text, r"\r?\n", -1), lambda line: line.rlike(level_2))
    kept = F.filter(groups, lambda g: g["text"].rlike(NOT_BLANK))
    each = _each(rows, key, text, kept, "section", "g")
    level_1 = r"^#\s+(.+?)\s*#*\s*$"
    head, first = F.col("g.head"), F.col("g.start") == 1
    title = F.when(head.rlike(level_2), F.regexp_extract(head, level_2, 1)).when(first & head.rlike(level_1), F.regexp_extract(head, level_1, 1)).otherwise("(top)")
    return each.select(key, "section", title.alias("title"), F.col("g.start").alias("line_start"), F.col("g.end").alias("line_end"), F.col("g.text").alias("text"))


def _paragraph_array(text: Column) -> Column:
    """Runs of non-blank lines: ``array<struct<start, end, text>>``."""

    def edges(filled: Column, side: int) -> Column:
        """Numbers of the filled lines without a filled neighbour on one side."""
        return F.array_compact(F.transform(filled, lambda on, i: F.when(on & ~F.coalesce(F.get(filled, i + side), F.lit(False)), i + 1)))

    def runs(ls: Column, begins: Column, ends: Column) -> Column:
        def run(first: Column, k: Column) -> Column:
            last = F.get(ends, k)
            return F.struct(first.alias("start"), last.alias("end"), trim_space(F.array_join(F.slice(ls, first, last - first + 1), "\n")).alias("text"))

        return F.transform(begins, run)

    filled = lambda ls: F.transform(ls, lambda x: x.rlike(NOT_BLANK))
    return _let(F.split(text, r"\r?\n", -1), lambda ls: _let(filled(ls), lambda on: _let(edges(on, -1), lambda begins: _let(edges(on, 1), lambda ends: runs(ls, begins, ends)))))


def paragraphs(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, paragraph, line_start, line_end, text``; ``paragraph`` counts from 0."""
    each = _each(rows, key, text, _paragraph_array(F.col(text)), "paragraph", "p")
    return each.select(key, "paragraph", F.col("p.start").alias("line_start"), F.col("p.end").alias("line_end"), F.col("p.text").alias("text"))


def heading_paths(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, n, level, path``: each heading with the headings that it stands under, joined by `` > ``."""
    found = F.filter(_numbered(F.split(text, r"\r?\n", -1)), lambda x: x["line"].rlike(HEADING))
    shaped = F.transform(found, lambda x: F.struct(x["n"].alias("n"), F.length(F.regexp_extract(x["line"], HEADING, 1)).alias("level"), F.regexp_extract(x["line"], HEADING, 2).alias("title")))
    zero = F.struct(F.array().cast("array<struct<n:int,level:int,title:string>>").alias("stack"), F.array().cast("array<struct<n:int,level:int,path:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < h["level"]), F.array(h))
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["n"].alias("n"), h["level"].alias("level"), path.alias("path")))).alias("out"))

    each = _each(rows, key, text, F.aggregate(shaped, zero, step, lambda acc: acc["out"]), "_i", "h")
    return each.select(key, "h.n", "h.level", "h.path")


def _split_lists(parts: Column, target: int) -> Column:
    """Paragraphs as long as the target, cut at their list items and packed line by line; others as they are."""
    item = r"^ {0,3}(?:[-*+]|\d+\.)\s+"
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def items(p: Column) -> Column:
        groups = _islands(F.split(p["text"], "\n", -1), lambda line: line.rlike(item))

        def step(done: Column, g: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            fits = (F.size(done) > 0) & (F.length(last["text"]) + 1 + F.length(g["text"]) <= target)
            lines_at = lambda c: (p["start"] + c - 1).cast("int")
            grown = F.struct(last["start"].alias("start"), lines_at(g["end"]).alias("end"), F.concat(last["text"], F.lit("\n"), g["text"]).alias("text"))
            fresh = F.struct(lines_at(g["start"]).alias("start"), lines_at(g["end"]).alias("end"), g["text"].alias("text"))
            return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

        return F.when(F.size(groups) > 1, F.aggregate(groups, empty, step)).otherwise(F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"))))

    marked = lambda ps, own: F.transform(ps, lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"), q["text"].alias("text"), F.lit(own).alias("own")))
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p["text"]) >= target, marked(items(p), True)).otherwise(marked(F.array(p), False))))


def pack_paragraphs(rows: DataFrame, key: str, text: str = "text", target: int = 900, split_lists: bool = False) -> DataFrame:
    """``key, chunk, line_start, line_end, n_chars, text``: paragraphs packed greedily.

    A paragraph joins the open chunk (after a blank line) unless that would exceed
    ``target``; a paragraph as long as the target is a chunk of its own.  With
    ``split_lists`` such a paragraph is cut at its list items, packed up to the target.
    """
    parts = _paragraph_array(F.col(text))
    parts = _split_lists(parts, target) if split_lists else F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), (F.length(p["text"]) >= target).alias("own")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string,size:int,full:boolean>>")

    def step(done: Column, p: Column) -> Column:
        size = F.length(p["text"])
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & ~last["full"] & ~p["own"] & (last["size"] + size + 2 <= target)
        grown = F.struct(last["start"].alias("start"), p["end"].alias("end"), F.concat(last["text"], F.lit("\n\n"), p["text"]).alias("text"), (last["size"] + size + 2).alias("size"), F.lit(False).alias("full"))
        fresh = F.struct(p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"), (size + 2).alias("size"), p["own"].alias("full"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    packed = F.aggregate(parts, empty, step)
    each = _each(rows, key, text, packed, "chunk", "c")
    return each.select(key, "chunk", F.col("c.start").alias("line_start"), F.col("c.end").alias("line_end"), F.length("c.text").alias("n_chars"), F.col("c.text").alias("text"))


def absolute_line(section_start: Column, relative: Column) -> Column:
    """The line in the file of a line in its section, both counted from 1."""
    return (section_start + relative - 1).cast("int")


def with_overlap(chunk_texts: Column, overlap: int = 150) -> Column:
    """Each chunk but the first begins with the trimmed end of the one before, as that came out itself."""
    empty = F.array().cast("array<string>")

    def step(done: Column, t: Column) -> Column:
        tail = trim_space(F.right(F.try_element_at(done, F.lit(-1)), F.lit(overlap)))
        return F.concat(done, F.array(F.when(F.size(done) == 0, t).otherwise(F.concat(tail, F.lit("\n\n"), t))))

    return F.aggregate(chunk_texts, empty, step)
