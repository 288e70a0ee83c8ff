"""Splitting oversized texts along their structure.

A text is parsed into a tree: sections by heading level, in them paragraphs, lists
with nested items, fenced code and tables; below a paragraph its sentences, then
its words.  A node that fits the limit is kept whole and merged with siblings, from
the bottom up; only a node that doesn't fit is opened.  Each piece then reaches
back over the end of the piece before it, from a natural place on.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡]+[”’」』）]*\s*|\r\n|\r|\n")
_WORD_END = re.compile(r"\s+|[，、；：,;]")


@dataclass
class Node:
    """A span of the text and the nodes that it's made of (none: a leaf)."""

    start: int
    end: int
    kind: str
    level: int = 0
    children: list[Node] = field(default_factory=list)


def _blocks(text: str) -> list[Node]:
    """Headings, lists, code, tables and paragraphs in order; blank lines belong to the block before."""
    blocks: list[Node] = []
    fence = ""
    for found in _LINE.finditer(text):
        start, end, line = found.start(), found.end(), found[0]
        if start == end:
            continue
        last = blocks[-1] if blocks else None
        if fence:
            last.end = end
            if line.strip().startswith(fence):
                fence = ""
                last.kind = "code"
            continue
        if not line.strip():
            if last is None:
                blocks.append(Node(start, end, "blank"))
            else:
                last.end = end
                last.level = 1  # closed by a blank line
            continue
        open_kind = last.kind if last is not None and not (last.level and last.kind != "list") else ""
        if opened := _FENCE.match(line):
            fence = opened[1]
            blocks.append(Node(start, end, "open code"))
        elif heading := _HEADING.match(line):
            blocks.append(Node(start, end, "heading", len(heading[1]) + 1))
        elif item := _ITEM.match(line):
            if open_kind != "list":
                blocks.append(Node(start, end, "list"))
            blocks[-1].end, blocks[-1].level = end, 0
            blocks[-1].children.append(Node(start, end, "item", len(item[1].expandtabs(4))))
        elif open_kind == "list" and not last.level:
            last.end = last.children[-1].end = end
        elif line.lstrip().startswith("|"):
            if open_kind == "table":
                last.end = end
            else:
                blocks.append(Node(start, end, "table"))
        elif open_kind == "paragraph":
            last.end = end
        else:
            blocks.append(Node(start, end, "paragraph"))
    return blocks


def _nest_items(block: Node) -> list[Node]:
    """Items of a list, each with the more deeply indented ones after it."""
    roots: list[Node] = []
    path: list[Node] = []
    items = block.children
    for i, item in enumerate(items):
        item.end = items[i + 1].start if i + 1 < len(items) else block.end
        while path and path[-1].level >= item.level:
            path.pop()
        if path:
            if not path[-1].children:
                path[-1].children.append(Node(path[-1].start, item.start, "paragraph"))
            path[-1].children.append(item)
            for above in path:
                above.end = item.end
        else:
            roots.append(item)
        path.append(item)
    return roots


def parse_tree(text: str) -> Node:
    """The structure tree of a text; the children of each node cover it without gaps."""
    root = Node(0, len(text), "section", 0)
    path = [root]
    for block in _blocks(text):
        if block.kind == "heading":
            level = block.level - 1 if block.level > 1 else 1
            match = _HEADING.match(text, block.start)
            level = len(match[1]) if match else level
            while path[-1].level >= level:
                path.pop()
            section = Node(block.start, block.end, "section", level)
            path[-1].children.append(section)
            path.append(section)
        if block.kind == "list":
            block.children = _nest_items(block)
        path[-1].children.append(block)
        for node in path:
            node.end = max(node.end, block.end)
    return root


def _cut(text: str, start: int, end: int, limit: int, pattern: re.Pattern) -> list[Node]:
    """Spans between the ends that ``pattern`` finds."""
    edges = [start, *(m.end() for m in pattern.finditer(text, start, end) if m.end() < end), end]
    return [Node(a, b, "part") for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _hard_cut(text: str, start: int, end: int, limit: int) -> list[Node]:
    """Spans of ``limit`` characters that keep marks and joined characters with their base."""
    out = []
    while end - start > limit:
        at = start + limit
        while at > start + 1 and (unicodedata.category(text[at]) in ("Mn", "Me", "Mc") or text[at] in "‍️" or text[at - 1] == "‍"):
            at -= 1
        if at == start + 1:
            at = start + limit
        out.append(Node(start, at, "part"))
        start = at
    return [*out, Node(start, end, "part")]


def _pack(text: str, node: Node, limit: int) -> list[tuple[int, int]]:
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    children = node.children
    if not children:
        for pattern in (re.compile(r"\r\n|\r|\n"),) * (node.kind in ("code", "open code", "table")) + (_SENTENCE_END, _WORD_END):
            children = _cut(text, node.start, node.end, limit, pattern)
            if len(children) > 1:
                break
        else:
            children = _hard_cut(text, node.start, node.end, limit)
    packed: list[tuple[int, int]] = []
    for child in children:
        for start, end in _pack(text, child, limit):
            if packed and end - packed[-1][0] <= limit:
                packed[-1] = (packed[-1][0], end)
            else:
                packed.append((start, end))
    return packed


def _reach_back(text: str, start: int, floor: int) -> int:
    """The earliest natural place from ``floor`` on where a piece that begins at ``start`` may begin."""
    for pattern in (_SENTENCE_END, _WORD_END):
        for found in pattern.finditer(text, floor, start):
            if floor < found.end() < start:
                return found.end()
    return start


def split_text(text: str, limit: int = 900, overlap: int = 150, blank: bool = False) -> list[tuple[int, int]]:
    """Spans of the pieces of a text, each of at most ``limit`` characters.

    All visible characters are covered.  A text within the limit is one piece; the
    empty text and white space alone are none.  With ``blank`` white space alone,
    beyond the limit, is cut at the limit.
    """
    if blank and len(text) > limit and text.isspace():
        return [(start, min(start + limit, len(text))) for start in range(0, len(text), limit)]
    if len(text) <= limit:
        return [(0, len(text))] if text.strip() else []
    pieces: list[tuple[int, int]] = []
    before = 0
    for start, end in _pack(text, parse_tree(text), max(1, limit - overlap)):
        while start < end and text[start].isspace() and text[start] not in " \t":
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            continue
        own = start
        if pieces and overlap:
            start = _reach_back(text, start, max(own - overlap, before))
        pieces.append((start, end))
        before = own
    return pieces


_PIECE = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("piece", "char_start", "char_end", "first_line", "last_line")] + [T.StructField("piece_text", T.StringType())]
    )
)


def _pieces_of(limit: int, overlap: int, blank: bool):
    @F.pandas_udf(_PIECE)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", text or "")]
                out.append([(i, a, b, bisect_right(breaks, a), bisect_right(breaks, b - 1), text[a:b]) for i, (a, b) in enumerate(split_text(text or "", limit, overlap, blank))])
            yield pd.Series(out, dtype=object)

    return column


def split_oversized(chunks: DataFrame, limit: int = 900, overlap: int = 150, blank: bool = False) -> DataFrame:
    """Pieces of all chunks whose text is longer than ``limit``.

    Input: ``chunk_id, memory_id, text, line_start`` (other columns are ignored).
    Output: ``chunk_id, piece, char_start, char_end, piece_text, line_start, line_end``;
    positions count code points in the stored text, consecutive pieces share up to
    ``overlap`` characters, and the same chunk row twice gives its pieces twice.
    Null and short texts give nothing; text of white space alone gives no piece, or
    with ``blank`` pieces cut at the limit.

    Line numbers are absolute where the chunk has a ``line_start``, else null; they
    don't rely on its ``line_end``.  A chunk that begins with the end of another of
    its memory (a soft overlap, followed by a blank line) counts its lines from
    behind that; a piece that lies wholly in it gets the chunk's first line.  That
    prefix is found by joining on the memory and the last characters of the prefix,
    so a memory with very many chunks isn't gathered anywhere.
    """
    end_key = 16
    big = chunks.where(F.length("text") > limit).select("chunk_id", "memory_id", "text", F.col("line_start").cast("int").alias("_base"))
    head = F.left(F.col("text"), F.lit(overlap + 2))
    starts = big.select("memory_id", F.xxhash64("text").alias("_text_id"), F.split(head, "\n\n").alias("_parts")).where("size(_parts) > 1").distinct()
    starts = starts.select("memory_id", "_text_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda n: F.concat_ws("\n\n", F.slice("_parts", 1, n)))).alias("_prefix")).where(F.length("_prefix") > 0)
    tails = chunks.where("text is not null").select("memory_id", F.regexp_replace(F.right("text", F.lit(overlap + 10)), r"\s+$", "").alias("_tail")).where(F.length("_tail") > 0)
    tails = tails.withColumn("_end", F.right("_tail", F.lit(end_key))).distinct()
    # An overlap shorter than the key is the whole of a short chunk, so both sides cut the key alike.
    met = starts.withColumn("_end", F.right("_prefix", F.lit(end_key))).hint("merge").join(tails.hint("merge"), ["memory_id", "_end"]).where(F.endswith(F.col("_tail"), F.col("_prefix")))
    lines_in = F.size(F.split("_prefix", "\r\n|\r|\n")) + 1
    prefixes = met.groupBy(F.col("memory_id").alias("_m"), F.col("_text_id").alias("_t")).agg(F.max(lines_in).alias("_skip"))
    pieces = big.withColumn("_p", F.explode(_pieces_of(limit, overlap, blank)(F.col("text")))).withColumn("_text_id", F.xxhash64("text"))
    full = pieces.join(prefixes, (F.col("memory_id") == F.col("_m")) & (F.col("_text_id") == F.col("_t")), "left")
    line = lambda c: F.col("_base") + F.greatest(F.col(c) - F.coalesce("_skip", F.lit(0)), F.lit(0))
    return full.select("chunk_id", "_p.piece", "_p.char_start", "_p.char_end", "_p.piece_text", line("_p.first_line").alias("line_start"), line("_p.last_line").alias("line_end"))
