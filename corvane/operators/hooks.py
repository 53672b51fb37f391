"""Boundary to models: hooks that add vector, score or text columns in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> Sequence[str]: ...


class HashEncoder:
    """Deterministic stand-in: words hashed to signed dimensions, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def encode(df: DataFrame, text: Column, encoder: Encoder, out: str = "embedding", error: str | None = "error") -> DataFrame:
    """``df`` with vectors; a batch that fails gets null vectors and the message in ``error`` instead of failing the job."""

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("v", pa.list_(pa.float64())), ("e", pa.string())])
        rows = [t or "" for t in texts.to_pylist()]
        try:
            v = encoder.encode(rows) if rows else []
            if len(v) != len(rows):
                raise ValueError(f"{len(v)} vectors for {len(rows)} texts")
            return pa.array([{"v": [float(y) for y in x], "e": None} for x in v], kind)
        except Exception as e:  # noqa: BLE001
            if not error:
                raise
            return pa.array([{"v": None, "e": str(e)} for _ in rows], kind)

    t = df.withColumn("__e", F.arrow_udf(run, "struct<v:array<double>,e:string>")(text)).withColumn(out, F.col("__e.v"))
    return (t.withColumn(error, F.col("__e.e")) if error else t).drop("__e")


def encode_missing(df: DataFrame, done: DataFrame, id_col: str, text: Column, encoder: Encoder) -> DataFrame:
    """Vectors of the rows whose identifier ``done`` lacks: a build resumes from what is written, and caches only grow."""
    return encode(df.join(done.select(id_col).distinct(), id_col, "left_anti"), text, encoder)


def score_pairs(df: DataFrame, query: Column, text: Column, scorer: PairScorer, out: str = "cross_encoder_score") -> DataFrame:
    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        pairs = [(a or "", b or "") for a, b in zip(q.to_pylist(), t.to_pylist(), strict=True)]
        return pa.array([float(x) for x in scorer.score(pairs)], pa.float64())

    return df.withColumn(out, F.arrow_udf(run, "double")(query, text))


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder in Spark functions: Jaccard of the two word sets."""
    return T.jaccard(F.array_distinct(T.words(query)), F.array_distinct(T.words(text)))


def max_log_pool(logits: Column, mask: Column) -> Column:
    """Sparse pooling of token logits: max over tokens of log(1 + relu(logit)) where ``mask`` is 1."""
    kept = F.transform(F.filter(logits, lambda v, i: F.get(mask, i) == 1), lambda v: F.transform(v, lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))))
    zero = F.transform(F.get(logits, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: F.greatest(a, b)))
