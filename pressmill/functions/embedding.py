"""Text to vectors: a protocol for models, and a deterministic one that needs none (feature hashing of tokens)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import tokens

QUERY_PROMPT = "Instruct: given a news search query, find the articles that answer it\nQuery: {text}"


class Embedder(Protocol):
    """Anything that turns a text column into an array<double> column."""

    dim: int

    def embed(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Counts tokens in ``dim`` signed buckets and scales to length one; no tokens give a null vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        toks = tokens(text)
        bucket = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(self.dim)))
        sign = F.transform(toks, lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        pairs = F.arrays_zip(bucket.alias("b"), sign.alias("s"))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        at = F.sequence(F.lit(0), F.lit(self.dim - 1))
        raw = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, at, lambda x, i: x + F.when(i == p["b"], p["s"]).otherwise(0.0)))
        return normalized(raw)


def normalized(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length))


def document_prompt(title: Column, content: Column, most: int = 8000) -> Column:
    return F.substring(F.concat_ws("\n", title, content), 1, most)


def vector_literal(values: list[float]) -> str:
    """[a,b,c] with the shortest decimal of each 32-bit float."""
    import numpy as np

    return "[" + ",".join(np.format_float_positional(np.float32(v), unique=True, trim="-") for v in values) + "]"
