"""Embeddings: providers, the deterministic stub, and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Provider(Protocol):
    """What turns texts into vectors; made once in each Python worker."""

    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_with(factory, dim: int):
    """A column function that embeds by a provider; ``factory`` makes it in the worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for texts in batches:
            vectors = provider.embed(list(texts.fillna("")))
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the provider's vectors don't have {dim} dimensions")
            yield pd.Series(vectors, dtype=object)

    return column


def stub_vector(text: Column, dim: int = 8) -> Column:
    """Numbers in about -1..1 from SHA-256 digests of a counter and the text; not of unit length."""
    out = []
    for c in range((dim + 7) // 8):
        digest = F.sha2(F.concat(F.lit(f"{c}\x00"), text), 256)
        for i in range(min(8, dim - 8 * c)):
            swapped = F.concat(*[F.substring(digest, 8 * i + 2 * k + 1, 2) for k in (3, 2, 1, 0)])
            value = F.conv(swapped, 16, 10).cast("long")
            out.append(F.when(value >= 2**31, value - 2**32).otherwise(value).cast("double") / 2147483647.0)
    return F.array(*out)


class HttpProvider:
    """Vectors from a service that takes ``{"model", "input"}`` and answers ``{"data": [{"index", "embedding"}]}``.

    ``post(url, body)`` sends a request and returns the parsed answer; it is given by
    the caller (with its key and retries).  Texts go in batches of ``batch``.  Spark
    may run a task again, and then its texts are sent (and billed) again.
    """

    def __init__(self, model_id: str, dim: int, post: Callable[[str, dict], dict], base_url: str, batch: int = 64, sends_dim: bool = False) -> None:
        self.model_id, self.dim, self.post, self.url, self.batch, self.sends_dim = model_id, dim, post, f"{base_url.rstrip('/')}/embeddings", batch, sends_dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list = [None] * len(texts)
        for start in range(0, len(texts), self.batch):
            part = texts[start : start + self.batch]
            body = {"model": self.model_id, "input": part} | ({"dimensions": self.dim} if self.sends_dim else {})
            data = self.post(self.url, body).get("data")
            if not isinstance(data, list) or len(data) != len(part):
                raise ValueError(f"{self.url} gave {len(data or [])} vectors for {len(part)} texts")
            for item in data:
                out[start + item["index"]] = item["embedding"]
        if any(v is None for v in out):
            raise ValueError(f"{self.url} left out a text")
        return out


class OnnxProvider:
    """Vectors from an ONNX encoder: mean over the tokens, of unit length.

    ``session`` has ``run(None, inputs)`` (an ``onnxruntime.InferenceSession``),
    ``encode(texts)`` gives ``(input_ids, attention_mask)`` arrays.  Models of the E5
    family want a prefix, which is the same for texts and questions.
    """

    def __init__(self, model_id: str, dim: int, session, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.model_id, self.dim, self.session, self.encode = model_id, dim, session, encode
        self.prefix = "passage: " if "e5" in model_id.lower() else ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        ids, mask = self.encode([self.prefix + t for t in texts])
        states = np.asarray(self.session.run(None, {"input_ids": ids, "attention_mask": mask})[0], dtype=np.float64)
        if states.shape[-1] != self.dim:
            raise ValueError(f"{self.model_id} gives {states.shape[-1]} dimensions, not {self.dim}")
        weight = mask[:, :, None].astype(np.float64)
        mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def _packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``keys, vectors``: blocks of at most ``size`` rows of one task; rows with a null in either, or in the vector, are left out.

    The tests are made here and not as a filter, which would compute a vector that is an expression once more.
    """
    kept = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    kind = kept.schema["k"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["k"].notna() & batch["v"].map(lambda v: v is not None and not pd.isna(v).any())]
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                yield pd.DataFrame({"keys": pd.Series([part["k"].to_numpy()], dtype=object), "vectors": [_matrix(part["v"]).tobytes()]})

    return kept.mapInPandas(pack, f"keys array<{kind}>, vectors binary")


def _best(at: np.ndarray, against: np.ndarray, top_n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``at`` the places and distances of at least its ``top_n`` nearest rows of ``against``.

    A product of the two blocks tells which rows can be among the nearest; these few
    are measured again by differences, so that rounding doesn't decide.
    """
    rough = (at * at).sum(axis=1)[:, None] + (against * against).sum(axis=1)[None, :] - 2.0 * (at @ against.T)
    slack = 1e-9 * (1.0 + float((at * at).sum(axis=1).max()) + float((against * against).sum(axis=1).max()))
    out = []
    for row, own in zip(rough, at, strict=True):
        edge = np.partition(row, top_n - 1)[top_n - 1] if len(row) > top_n else np.inf
        places = np.flatnonzero(row <= edge + slack + 4e-9 * np.sqrt(max(edge, 0.0))) if edge < np.inf else np.arange(len(row))
        out.append((places, np.round(np.sqrt(((against[places] - own) ** 2).sum(axis=1)), 9)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, top_n: int = 40, key: str = "chunk_id", block: int = 2048, most_broadcast: int = 64_000_000) -> DataFrame:
    """``query_id, key, distance, rank``: the exact ``top_n`` by L2 distance (to 9 digits), ties by ``key``.

    ``vectors`` has ``key, vector``; ``queries`` has ``query_id, vector`` and is a
    stated set against all rows.  Both are packed into blocks; each pair of blocks is
    one product of matrices, of which each query's best rows go on, so what is
    shuffled is about ``top_n`` rows a query and block.  Rows with a null key or
    vector, or a null or NaN in the vector, are left out; all vectors need one length.

    The queries' blocks are broadcast up to ``most_broadcast`` bytes, which are
    counted; beyond that blocks meet by a product of partitions, and nothing is broadcast.
    """
    kind, q_kind = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = _packed(queries, "query_id", "vector", block).select(F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"))
    n_bytes = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()[0]
    given = _packed(vectors, key, "vector", block)
    pairs = given.crossJoin(F.broadcast(asked)) if n_bytes <= most_broadcast else given.hint("shuffle_replicate_nl").crossJoin(asked)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, raw, q_keys, q_raw in zip(batch["keys"], batch["vectors"], batch["q_keys"], batch["q_vectors"], strict=True):
                at, against = np.frombuffer(q_raw).reshape(len(q_keys), -1), np.frombuffer(raw).reshape(len(keys), -1)
                if at.shape[1] != against.shape[1]:
                    raise ValueError(f"vectors of {against.shape[1]} dimensions against queries of {at.shape[1]}")
                keys = np.asarray(keys)
                for q, (places, distances) in zip(q_keys, _best(at, against, top_n), strict=True):
                    yield pd.DataFrame({"query_id": [q] * len(places), key: keys[places], "distance": distances})

    close = pairs.mapInPandas(_in_batches(measure), f"query_id {q_kind}, `{key}` {kind}, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", key)
    return close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def _in_batches(measure, rows: int = 50_000):
    """Joins the small frames of ``measure`` to larger ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in measure(batches):
            held.append(frame)
            size += len(frame)
            if size >= rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run
