"""Approximate nearest vectors of one query from a stored index: vectors lie in folders by cell, and only the likeliest cells are read.

The exact way is ``retrieval.nearest``, over all vectors. Defined results: vectors of another length, with nulls or values that aren't finite, or all
zero, are not indexed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.projections import cells, directions, probes, unit
from pressmill.operators import retrieval as R
from pressmill.session import materialize

CELL, SAMPLE, MOST_LEVELS, RADIUS, SURE = 2048, 5000, 14, 0.95, 0.98


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # the rows given, with their cell
    cuts: np.ndarray


def build(vectors: DataFrame, dim: int = 64, cell: int = CELL, keep: bool = False) -> VectorIndex:
    """vectors(id, embedding, ...) by cell; the cuts are medians of a sample of SAMPLE rows by hash of the id."""
    ok = f"size(embedding) = {dim} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    own = vectors.where(ok)
    n = own.count()
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(n, 1) / cell))))
    some = own.select("embedding").where(F.pmod(F.xxhash64("id"), F.lit(10**6)) < min(1.0, SAMPLE / max(n, 1)) * 10**6).limit(2 * SAMPLE).collect()
    x = unit(np.array([r["embedding"] for r in some], float)) @ directions(dim, 0, levels) if levels and some else np.zeros((1, levels))
    cuts = np.median(x, axis=0)

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = unit(b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells(v @ directions(dim, 0, levels) - cuts).astype(np.int32))], [*b.schema.names, "cell"])

    placed = own.mapInArrow(place, T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())]))
    return VectorIndex(materialize(placed.repartitionByRange("cell").sortWithinPartitions("cell"), "vector-cells", keep), cuts)


def nearest(index: VectorIndex, query: list[float], k: int, radius: float = RADIUS, sure: float = SURE) -> DataFrame:
    """(id, distance) as the exact search has it, from the cells that hold a neighbour within the radius with probability ``sure`` together."""
    place = unit(np.array([query], float)) @ directions(len(query), 0, len(index.cuts)) - index.cuts
    _, cell = probes(place, np.array([radius]), sure)
    return R.nearest(index.vectors.where(F.col("cell").isin([int(c) for c in cell])), query, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found; 1 where there are none. Both have k rows at most."""
    want, got = {r["id"] for r in exact.select("id").collect()}, {r["id"] for r in found.select("id").collect()}
    return len(want & got) / len(want) if want else 1.0
