"""Near-duplicate texts: an inverted index over positional digests with count filtering.

Every distinct text gets a digest: for each of some hundred positions the least hash
of its shingles that falls there (one-permutation hashing).  Two texts agree at a
position with a probability equal to their similarity.

*Index.*  A single position (one byte, or even one hash) would list a fixed part of
all texts under each of its values, since texts of one language share much, and the
pairs under it would grow with the square of the corpus.  So a posting's key is made
from ``rows`` positions at once, and each text has as many postings as the threshold
needs (``postings_needed``).

*Count filter.*  With each posting goes one bit of each of 256 positions.  Where two
texts meet, the positions at which their bits agree are tallied on the spot, and the
pair goes on only if the tally reaches the minimum that a pair at the threshold has
(``least_of``).  Then the postings that the pair shares are tallied, with the minimum
that follows from the threshold in the same way.

*Verification.*  What is left is compared exactly, shingle by shingle.

Both minima are quantiles: of the pairs at the threshold the postings may lose the
share ``missed`` and the bits half of it, of more similar ones far less
(``expected_recall``).  Pairs that are found are right.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut, written

_BINS = 128
_BITS = 256
_WORDS = _BITS // 64
#: Bits of a listing's key.  Keys that meet by chance cost a comparison of two summaries, never a pair: listings stay narrow and nothing is lost.
_KEY_BITS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _alphanumeric() -> np.ndarray:
    """For each code point whether it's a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_ALNUM = _alphanumeric()
#: Characters that one round of array work handles, so that a batch of long texts stays small.
_ROUND = 800_000


def _rounds(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > _ROUND:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins (and the last ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def normalise_all(texts: list[str]) -> list[str]:
    """Lower case, each run of characters other than letters and digits one space."""
    out: list[str] = []
    for part in _rounds(texts):
        points, edges = _points([t.lower() for t in part])
        if not len(points):
            out += [""] * len(part)
            continue
        counted = _ALNUM[points]
        after_counted = np.concatenate(([True], counted[:-1]))
        after_counted[edges[:-1][edges[:-1] < len(points)]] = True
        keep = counted | after_counted
        joined = np.where(counted, points, np.uint32(32))[keep].tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.concatenate(([0], np.cumsum(keep)))[edges]
        out += [joined[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each ``size``-character substring of each text, and the number of its text."""
    points, edges = _points(texts)
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    wide = points.astype(np.uint64)
    h = wide[:n].copy()
    for i in range(1, size):
        h *= _MIX
        h += wide[i : i + n]
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    within = owner[:n] == owner[size - 1 : size - 1 + n]
    return _mix(h[within]), owner[:n][within]


def _donors() -> np.ndarray:
    """For each empty position, the positions to borrow from, in order."""
    return np.stack([np.random.default_rng(position).permutation(_BINS) for position in range(_BINS)])


_DONORS = _donors()


def digests(texts: list[str], size: int, parts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``(n, 128 * parts)`` digests and a mask of the texts that have shingles at all.

    A position that no shingle of a text falls on borrows from others, in an order
    that is the same for all texts, so that it still agrees as often as the texts do.
    """
    values, owner = shingle_hashes(texts, size)
    some = np.zeros(len(texts), dtype=bool)
    some[owner] = True
    out = np.zeros((len(texts), parts * _BINS), dtype=np.uint64)
    if not some.any():
        return out, some
    nothing = np.uint64(0xFFFFFFFFFFFFFFFF)
    for part in range(parts):
        v = values if part == 0 else _mix(values + np.uint64(part * int(_MIX) % 2**64))
        least = np.full(len(texts) * _BINS, nothing, dtype=np.uint64)
        np.minimum.at(least, owner * _BINS + (v >> np.uint64(57)).astype(np.int64), v)
        least = least.reshape(len(texts), _BINS)
        filled = least.copy()
        row, col = np.nonzero((least == nothing) & some[:, None])
        for step in range(_BINS):
            if not len(row):
                break
            borrowed = least[row, _DONORS[col, step]]
            filled[row, col] = borrowed
            still = borrowed == nothing
            row, col = row[still], col[still]
        out[:, part * _BINS : (part + 1) * _BINS] = filled
    return out, some


def postings_needed(threshold: float, rows: int, missed: float) -> int:
    """So many postings that a pair at the threshold shares none of them with a probability of at most ``missed``."""
    return ceil(log(missed) / log(1 - threshold**rows)) if threshold < 1 else 1


def _tail(n: int, p: float, least: int) -> float:
    """The probability of at least ``least`` successes in ``n`` trials."""
    return 1.0 - sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))


def least_of(n: int, p: float, missed: float) -> int:
    """The largest minimum that ``n`` trials with probability ``p`` miss with a probability of at most ``missed`` (one at least)."""
    least = 1
    while least < n and _tail(n, p, least + 1) >= 1 - missed:
        least += 1
    return least


def _agree(similarity: float) -> float:
    return similarity + (1 - similarity) / 2


def expected_recall(similarity: float, threshold: float = 0.6, rows: int = 5, missed: float = 0.002) -> float:
    """The share of pairs of a similarity that are found if positions are independent: both tallies reach their minimum."""
    n = postings_needed(threshold, rows, missed)
    shared = _tail(n, similarity**rows, least_of(n, threshold**rows, missed))
    return shared * _tail(_BITS, _agree(similarity), least_of(_BITS, _agree(threshold), missed / 2))


def _parts(rows: int, postings: int) -> int:
    """Blocks of 128 positions: the bits need two; a few postings more than fit use positions again."""
    return max(_BITS // _BINS, round(rows * postings / _BINS))


def _posting_keys(digest: np.ndarray, rows: int, postings: int) -> np.ndarray:
    keys = np.empty((len(digest), postings), dtype=np.uint64)
    for n in range(postings):
        h = np.full(len(digest), n + 1, dtype=np.uint64)
        for i in range(n * rows, n * rows + rows):
            h = _mix(h * _MIX + digest[:, i % digest.shape[1]])
        keys[:, n] = h
    return (keys >> np.uint64(64 - _KEY_BITS)).view(np.int64)


def _summary(digest: np.ndarray) -> np.ndarray:
    """64-bit words that hold one bit of each of the first 256 positions."""
    picked = _mix(digest[:, :_BITS] + np.uint64(1)) & np.uint64(1)
    return np.packbits(picked.astype(np.uint8), axis=1).view(np.int64)


_DIGEST = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), *[T.StructField(f"s{i}", T.LongType()) for i in range(_WORDS)]])


def _digest_column(size: int, rows: int, postings: int):
    parts = _parts(rows, postings)

    @F.pandas_udf(_DIGEST)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, words = [], []
            for part in _rounds(list(texts)):
                digest, some = digests(part, size, parts)
                own = _posting_keys(digest, rows, postings)
                keys += [k if ok else k[:0] for k, ok in zip(own, some, strict=True)]
                words.append(_summary(digest))
            both = np.concatenate(words) if words else np.empty((0, _WORDS), dtype=np.int64)
            yield pd.DataFrame({"keys": pd.Series(keys, dtype=object)} | {f"s{i}": both[:, i] for i in range(_WORDS)})

    return column


@F.pandas_udf(T.StringType())
def _normalised_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(normalise_all(list(texts)), dtype=object)


def _agreeing() -> Column:
    """How many bits of two summaries agree."""
    return F.lit(_BITS) - sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, _WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))


def _similarity(a: str, b: str, size: int) -> float:
    one, two = {a[i : i + size] for i in range(len(a) - size + 1)}, {b[i : i + size] for i in range(len(b) - size + 1)}
    return len(one & two) / len(one | two)


def _verify(size: int, threshold: float):
    @F.pandas_udf(T.BooleanType())
    def column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            texts = list(dict.fromkeys([*left, *right]))
            sets: list[np.ndarray] = []
            for part in _rounds(texts):
                values, owner = shingle_hashes(part, size)
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                short = values.astype(np.uint32)
                sets += [np.unique(short[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            of = {text: n for n, text in enumerate(texts)}
            out = []
            for a, b in zip(left, right, strict=True):
                one, two = sets[of[a]], sets[of[b]]
                both = np.concatenate((one, two))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                similar = shared / (len(both) - shared)
                # Counted by 32-bit hashes; what lies near the threshold is counted by the strings themselves.
                out.append(similar >= threshold if abs(similar - threshold) > 0.01 else _similarity(a, b, size) >= threshold - 1e-12)
            yield pd.Series(out, dtype=bool)

    return column


def text_classes(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, id, check, norm``: rows whose normalised texts are equal share ``id`` and ``check``, 128 bits together.

    Rows without a key, and texts too short to have a shingle, are left out.
    """
    norm = rows.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), _normalised_column(F.col(f"`{text}`")).alias("norm"))
    return norm.where(F.length("norm") >= size).select("key", F.xxhash64("norm").alias("id"), _check().alias("check"), "norm")


def _check() -> Column:
    """64 bits beside those of ``id``."""
    return F.xxhash64(F.lit(7), "norm")


def distinct_texts(each: DataFrame) -> DataFrame:
    """``id, check, norm``, one row for each text.  Copies are combined in the map tasks; texts that meet on an ``id`` stay apart."""
    sets = each.groupBy("id").agg(F.collect_set("norm").alias("texts"))
    return sets.select("id", F.explode("texts").alias("norm")).select("id", _check().alias("check"), "norm")


def similar_texts(texts: DataFrame, size: int = 5, threshold: float = 0.6, rows: int = 5, missed: float = 0.002) -> DataFrame:
    """``id_a, check_a, id_b, check_b`` for pairs of different texts with similarity of at least ``threshold``, with ``expected_recall``.

    ``texts`` has one row for each text: ``id, check, norm``.  A hot posting (texts
    that all agree at its positions) is a large partition of the join, which
    adaptive execution splits; nothing is gathered or cut off.

    Texts and postings are never broadcast: Spark takes a string for 20 bytes, so
    its estimate of their size can be far too low.
    """
    n = postings_needed(threshold, rows, missed)
    least_shared, least_agreeing = least_of(n, threshold**rows, missed), least_of(_BITS, _agree(threshold), missed / 2)
    listed = texts.select("id", _digest_column(size, rows, n)(F.col("norm")).alias("d"))
    words = range(_WORDS)
    # The key stands last: what its text's postings in a partition have in common is then one run, which compresses.
    index = listed.select("id", *[f"d.s{i}" for i in words], F.explode("d.keys").alias("k"))
    other = index.select(F.col("id").alias("id_b"), *[F.col(f"s{i}").alias(f"t{i}") for i in words], "k")
    met = index.withColumnRenamed("id", "id_a").hint("merge").join(other.hint("merge"), "k")
    kept = met.where((F.col("id_a") < F.col("id_b")) & (_agreeing() >= least_agreeing))
    candidates = kept.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared).select("id_a", "id_b")
    side = lambda end: texts.select(*[F.col(c).alias(f"{c}_{end}") for c in ("id", "check", "norm")]).hint("merge")
    both = candidates.hint("merge").join(side("a"), "id_a").hint("merge").join(side("b"), "id_b")
    return both.where(_verify(size, threshold)("norm_a", "norm_b")).select("id_a", "check_a", "id_b", "check_b")


_SIDE = {"a": ["id_a", "check_a"], "b": ["id_b", "check_b"]}


def _renamed(df: DataFrame, end: str) -> DataFrame:
    return df.withColumnsRenamed({"id": f"id_{end}", "check": f"check_{end}"})


def near_duplicate_pairs(rows: DataFrame, key: str = "chunk_id", text: str = "text", size: int = 5, threshold: float = 0.6, per_salt: int = 1000) -> DataFrame:
    """Pairs of rows whose texts are similar: ``<key>_a < <key>_b``, without repeats; all but the share that ``expected_recall`` leaves.

    Similarity is the Jaccard index of the sets of ``size``-character substrings of
    the normalised texts.  Rows with a null key, a null text or a text without any
    such substring are in no pair; rows that share a key count as one.

    Equal texts are one class throughout and are expanded only at the end.  There
    the members of a class are spread over one salt for each ``per_salt`` of them,
    on both sides of a link, so that no task expands a large class alone.
    """
    each = text_classes(rows, key, text, size)
    members = written(each.select("key", "id", "check"))
    links = cut(similar_texts(distinct_texts(each), size, threshold))
    sizes = members.groupBy("id", "check").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("check_a").alias("check")), F.struct(F.col("id_b").alias("id"), F.col("check_b").alias("check")))).alias("e")).select("e.*").distinct()
    linked = sizes.join(ends.withColumn("is_end", F.lit(True)), ["id", "check"], "left").where("n > 1 or is_end")
    salts = linked.select("id", "check", F.ceil(F.col("n") / per_salt).cast("int").alias("salts"))
    salted = members.hint("merge").join(salts.hint("merge"), ["id", "check"]).select("key", "id", "check", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))

    again = linked.where("n > 1").select("id", "check")
    itself = _renamed(again, "a").select("*", F.col("id_a").alias("id_b"), F.col("check_a").alias("check_b"))
    spread = links.unionByName(itself)
    for end in "ab":
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(f"salt_{end}")
        spread = spread.hint("merge").join(_renamed(salts, end).hint("merge"), _SIDE[end]).select(*[c for c in spread.columns], every)
    for end in "ab":
        side = _renamed(salted, end).withColumnsRenamed({"key": f"key_{end}", "salt": f"salt_{end}"})
        spread = spread.hint("merge").join(side.hint("merge"), [*_SIDE[end], f"salt_{end}"])
    different = (F.col("id_a") != F.col("id_b")) | (F.col("check_a") != F.col("check_b"))
    pairs = spread.where(different | (F.col("key_a") < F.col("key_b")))
    ordered = pairs.select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return ordered.distinct()


def duplicate_classes(rows: DataFrame, key: str = "chunk_id", text: str = "text", size: int = 5, threshold: float = 0.6) -> DataFrame:
    """One row for each key: ``key, class_id, n_copies, n_links``.

    Rows with equal normalised texts share ``class_id`` (128 bits in hexadecimal);
    ``n_links`` counts the other classes that are similar.  A key that is there
    several times gives one row for each text.
    """
    each = text_classes(rows, key, text, size)
    members = written(each.select("key", "id", "check").distinct())
    links = similar_texts(distinct_texts(each), size, threshold)
    end = lambda e: F.struct(F.col(f"id_{e}").alias("id"), F.col(f"check_{e}").alias("check"))
    n_links = links.select(F.explode(F.array(end("a"), end("b"))).alias("e")).groupBy("e.id", "e.check").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("id", "check").agg(F.count(F.lit(1)).alias("n_copies"))
    # One row a class on the right; a hot class is a large partition of the left side, which adaptive execution splits.
    both = members.hint("merge").join(sizes.join(n_links.hint("merge"), ["id", "check"], "left").hint("merge"), ["id", "check"])
    hexed = F.lower(F.concat(F.lpad(F.hex("id"), 16, "0"), F.lpad(F.hex("check"), 16, "0")))
    return both.select(F.col("key").alias(key), hexed.alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
