"""Filling containers of fixed capacity: sum-of-squares packing of documents by their size in tokens.

Items are spread by hash over shards of about SHARD items, and packed online in each: an item goes to the fill level for
which the sum over levels of the squared number of open containers grows least; ties go to the fullest one. The levels are
one array of counts, an item costs a few array operations; a shard's items arrive in the order of their ids, whatever their sizes. Only ids and sizes are
shuffled; a shard has a bounded number of items, whatever the sizes or sources are, and leaves at most the few containers open that it can't fill.

Items beyond the capacity are cut into full containers and a rest that is packed like an item; no other is cut.

Defined results: a null text has no size and isn't packed; an empty one has size 1 (the end token). Repeated ids are packed
once, rows without an id not at all. Containers are numbered within their shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD = 4096, 50_000
PLACED = "doc_id long, shard int, container long, part int, tokens int, split boolean"


def byte_tokens(column: str = "text"):
    """Size in tokens of the byte-level tokenizer of ByT5: one token per UTF-8 byte and one for the end."""
    return F.octet_length(column) + 1


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Containers of items of at most capacity, in the order given."""
    counts = np.zeros(capacity + 1, np.int64)  # open containers by fill level
    growth = np.zeros(capacity + 1, np.int64)
    open_at: dict[int, list[int]] = {}
    out, used = np.zeros(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        room = capacity - s
        # growth of the sum of squares by moving one container from level h to h + s; full containers count nothing
        g = growth[: room + 1]
        np.subtract(counts[s:], counts[: room + 1], out=g)
        g[room] = -counts[room]
        g[counts[: room + 1] == 0] = capacity * capacity
        fresh = counts[s] if s < capacity else 0
        level = room - int(np.argmin(g[::-1])) if room >= 0 else 0
        # a move changes the sum by 2 (growth + 1), 2 growth + 1 if the container gets full; a new container by 2 fresh + 1
        moved = 2 * int(g[level]) + (1 if level == room else 2)
        if level > 0 and counts[level] > 0 and moved <= 2 * fresh + 1:
            counts[level] -= 1
            box = open_at[level].pop()
        else:
            level, box = 0, used
            used += 1
        out[k] = box
        if level + s < capacity:
            counts[level + s] += 1
            open_at.setdefault(level + s, []).append(box)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """items(doc_id, tokens) to a row per piece: (doc_id, shard, container, part, tokens, split)."""
    items = items.where("tokens IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").cast("long").alias("tokens"))
    shards = max(1, -(-items.count() // shard))

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id")
        size = g["tokens"].to_numpy()
        whole, rest = size // capacity, size % capacity
        packed = np.where(size <= capacity, size, rest)
        item = np.flatnonzero(packed > 0)
        box = place(packed[item], capacity)
        used = int(box.max()) + 1 if len(box) else 0
        full = np.where(size > capacity, whole, 0)
        owner = np.repeat(np.arange(len(g)), full)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        ids = g["doc_id"].to_numpy()
        return pd.DataFrame({
            "doc_id": np.concatenate((ids[owner], ids[item])), "shard": g["shard"].iloc[0],
            "container": np.concatenate((used + np.arange(len(owner)), box)), "part": np.concatenate((part, full[item])).astype(np.int32),
            "tokens": np.concatenate((np.full(len(owner), capacity), packed[item])).astype(np.int32), "split": np.concatenate((np.ones(len(owner), bool), size[item] > capacity)),
        })

    spread = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(fill, PLACED)


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per container: its documents and unused tokens."""
    return placed.groupBy("shard", "container").agg(F.count("*").alias("pieces"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))


def cut_items(placed: DataFrame) -> DataFrame:
    """(doc_id) of the items that didn't go into one container."""
    return placed.where("part = 1").select("doc_id")


def summary(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, those filled beyond the capacity, tokens placed, and the share of the containers' room that is used."""
    each = containers(placed, capacity)
    return each.agg(
        F.count("*").alias("containers"), F.count_if(F.col("unused") < 0).alias("over"), F.sum(capacity - F.col("unused")).alias("tokens"),
        (1 - F.sum("unused") / (F.lit(capacity) * F.count("*"))).alias("used"),
    )
