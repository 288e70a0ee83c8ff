"""Evaluation texts inside a corpus: Wu-Manber multi-pattern search.

Every window of ``span`` consecutive units of an evaluation text is a pattern: its
words, or its characters where the item is written without spaces.  A Wu-Manber
matcher built from the patterns slides over the documents.  The last *block* of its
window (two words or three characters) is looked up in a shift table; a block that no
pattern holds lets the matcher jump by nearly a whole window.  Where the shift is 0
the bucket of the window's hash lists the patterns that can end there, and a direct
comparison of the wording decides.

Units are numbers (those of the items' words, 0 for any other word, or code points),
and all documents of a batch are searched side by side: in each round every document
makes one jump, and only the blocks that it lands on are looked at.  The corpus is
read once for each block of items, without a shuffle; the items stay in the shared
folder (``llm.blocks``) and never pass through the driver.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import read_block, write_blocks

#: Languages of items that are compared by characters.
CHARACTER_LANGS = ("zh",)
_WORD = re.compile(r"[^\W_]+")
def _class(start: int, end: int) -> re.Pattern:
    """The characters of a range that don't count: formats and marks."""
    return re.compile("[" + "".join(f"\\U{i:08x}" for i in range(start, end) if unicodedata.category(chr(i)) in ("Cf", "Mn")) + "]+")


#: Within the first plane a class is a table; the others are looked at only in texts that have their characters.
_DROPPED, _DROPPED_BEYOND = _class(0, 0x10000), _class(0x10000, sys.maxunicode + 1)
#: Units of one document that are searched as one; longer ones are searched in slices that overlap.
_SLICE = 20_000
#: Characters of documents that are searched at once, and those of one slice of an item.
_ROUND, _ITEM_SLICE = 2_000_000, 100_000


def folded(text: str) -> str:
    """Lower case without marks that don't count, so that equal wording is equal text."""
    if text.isascii():
        return text.lower()
    kept = _DROPPED.sub("", unicodedata.normalize("NFKC", text).lower())
    return _DROPPED_BEYOND.sub("", kept) if max(kept, default="") > "\uffff" else kept


def words_of(text: str) -> list[str]:
    return _WORD.findall(folded(text))


def characters_of(text: str) -> str:
    return "".join(words_of(text))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_at(units: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` units from each start."""
    h = np.zeros(len(starts), dtype=np.uint64)
    for i in range(n):
        h = h * _BASE + units[starts + i].astype(np.uint64)
    return _mix(h)


class WuManber:
    """Search for all windows of ``span`` units of the given texts; ``block`` units index the shift table.

    ``texts`` are lists of words, or strings for a search by characters; ``ids`` names
    the text that a window is from.
    """

    def __init__(self, texts: list, ids: list[int], by_word: bool, span: int, block: int) -> None:
        self.texts, self.ids, self.by_word, self.span, self.block = texts, np.array(ids, dtype=np.int64), by_word, span, block
        self.far = span - block + 1
        self.number: dict[str, int] = {}
        if by_word:
            for words in texts:
                for word in words:
                    self.number.setdefault(word, len(self.number) + 1)
        units, edges = self._units(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(edges))
        starts = np.arange(max(0, len(units) - span + 1))
        starts = starts[owner[starts] == owner[starts + span - 1]] if len(starts) else starts
        hashes = _hash_at(units, starts, span)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[starts[order]].astype(np.int32) if len(starts) else np.empty(0, dtype=np.int32)
        self.at = (starts - edges[owner[starts]])[order].astype(np.int32) if len(starts) else np.empty(0, dtype=np.int32)
        # A table of 8 to 16 places for each block: blocks that meet in a place have the least of their shifts.
        size = max(12, int(np.ceil(np.log2(8 * max(1, len(units))))))
        self.mask = np.uint64((1 << size) - 1)
        self.shift = np.full(1 << size, self.far, dtype=np.uint8 if self.far < 256 else np.int32)
        if len(starts):
            places = self._places(units, np.arange(len(units) - block + 1))
            for end in range(block, span + 1):
                np.minimum.at(self.shift, places[starts + end - block], span - end)

    def __len__(self) -> int:
        return len(self.hashes)

    def _units(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in a row, and where each text's begin (and the last ends)."""
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if not self.by_word:
            return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), edges
        number = self.number.get
        return np.fromiter((number(w, 0) for words in texts for w in words), dtype=np.uint32, count=int(edges[-1])), edges

    def _places(self, units: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The places in the shift table of the blocks that begin at ``starts``."""
        return (_hash_at(units, starts, self.block) & self.mask).astype(np.int64)

    def find(self, texts: list) -> list[tuple[int, int]]:
        """``(number of the text, id)`` for each text that holds a window, without repeats."""
        if not len(self) or not texts:
            return []
        units, edges = self._units(texts)
        span, block = self.span, self.block
        # Long texts as slices that overlap by a window less one unit.
        bounds = [(n, s, min(s + _SLICE + span - 1, b)) for n, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) for s in range(a, max(a + 1, b - span + 1), _SLICE)]
        owner, begin, limit = (np.array(x, dtype=np.int64) for x in zip(*bounds, strict=True))
        hit_owner, hit_start = [], []
        some = begin + span <= limit
        owner, end, limit = owner[some], (begin + span)[some], limit[some]
        while len(end):
            step = self.shift[self._places(units, end - block)].astype(np.int64)
            stops = step == 0
            if stops.any():
                hit_owner.append(owner[stops])
                hit_start.append(end[stops] - span)
            end = end + np.maximum(step, 1)
            left = end <= limit
            if not left.all():
                owner, end, limit = owner[left], end[left], limit[left]
        if not hit_owner:
            return []
        owners, starts = np.concatenate(hit_owner), np.concatenate(hit_start)
        hashes = _hash_at(units, starts, span)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        there = high > low
        found: dict[tuple[int, int], None] = {}
        for n, start, a, b in zip(owners[there].tolist(), starts[there].tolist(), low[there].tolist(), high[there].tolist(), strict=True):
            here = start - int(edges[n])
            for k in range(a, b):
                own, at = int(self.owner[k]), int(self.at[k])
                pair = (n, int(self.ids[own]))
                if pair not in found and texts[n][here : here + span] == self.texts[own][at : at + span]:
                    found[pair] = None
        return list(found)


def item_slices(items: DataFrame, words: int, characters: int) -> DataFrame:
    """``item_id, by_word, text, cost``: folded texts of items in slices that hold all their windows.

    ``cost`` are the bytes that a slice needs in a matcher: its text, and for each
    unit a hash, two places and its part of the shift table.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item_id, lang, text in zip(batch["item_id"], batch["lang"], batch["text"], strict=True):
                by_word = lang not in CHARACTER_LANGS
                units = words_of(text) if by_word else characters_of(text)
                span, joint = (words, " ") if by_word else (characters, "")
                step = max(1, _ITEM_SLICE // (8 if by_word else 1))
                for start in range(0, len(units) - span + 1, step):
                    part = joint.join(units[start : start + step + span - 1])
                    n = min(len(units) - start, step + span - 1)
                    rows.append((item_id, by_word, part, 4 * len(part) + 40 * n))
            yield pd.DataFrame(rows, columns=["item_id", "by_word", "text", "cost"]).astype({"item_id": "int64", "by_word": bool, "text": object, "cost": "int64"})

    wanted = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("long").alias("item_id"), "lang", "text")
    return wanted.mapInPandas(cut, "item_id long, by_word boolean, text string, cost long").distinct()


def _search(path: str, block: int, words: int, characters: int, key: str):
    def make(rows: pd.DataFrame) -> list[WuManber]:
        matchers = []
        for by_word, span, size in ((True, words, 2), (False, characters, 3)):
            own = rows[rows["by_word"] == by_word] if len(rows) else rows
            texts = list(own["text"]) if len(own) else []
            matchers.append(WuManber([t.split(" ") for t in texts] if by_word else texts, list(own["item_id"]) if len(own) else [], by_word, span, min(size, span)))
        return matchers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_word, by_character = read_block(path, block, make)
        for batch in batches:
            numbers, hits = [], []
            part: list[list[str]] = []
            first = size = 0
            for n, text in enumerate([*batch["t"], None]):
                if text is None or (part and size + len(text) > _ROUND):
                    found = by_word.find(part) + (by_character.find(["".join(row) for row in part]) if len(by_character) else [])
                    numbers += [first + number for number, _ in found]
                    hits += [hit for _, hit in found]
                    part, first, size = [], n, 0
                if text is not None:
                    part.append(_WORD.findall(folded(text)))
                    size += len(text)
            yield pd.DataFrame({key: batch["k"].iloc[numbers].reset_index(drop=True), "item_id": pd.Series(hits, dtype="int64")})

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 12,
    characters: int = 20,
    block_bytes: int = 128_000_000,
) -> DataFrame:
    """Which documents hold which evaluation items: ``key, item_id``, without repeats.

    A document holds an item if ``words`` consecutive words of the item's text (for
    items in Chinese ``characters`` consecutive characters) occur in it; case,
    width, punctuation, white space and markdown marks don't count.  Null, empty
    and shorter texts on either side give no row, nor do null keys on either side.
    Documents that share a key count as one.  Other columns of both inputs are
    ignored, whatever their names.

    Items are searched in blocks whose matchers need about ``block_bytes`` in a
    worker; each block is a pass over the documents, and every block is searched.
    """
    read = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    path, n_blocks = write_blocks(item_slices(items, words, characters), "cost", block_bytes)
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id bigint"
    found = None
    for block in range(n_blocks):
        hits = read.mapInPandas(_search(path, block, words, characters, key), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
