"""Evaluation texts leaking into training text: winnowed fingerprints, joined, and the hits extended.

Of every window of consecutive k-grams the smallest hash is kept, on both sides. With k-grams of K words and windows of
SHARED - K + 1 of them, any SHARED consecutive words that two texts have in common yield at least one common fingerprint;
each hit is then extended to both sides over the words themselves, so a reported span has at least SHARED words.

The held-out side is sent to all tasks only if it has at most MOST_HELD_OUT_WORDS words (its size is counted first). A
larger one goes the other way: fingerprints of both sides are shuffled by hash (and a salt, so that one that a third of the documents have is
SALT groups), candidate pairs are reduced to distinct texts and items, and the texts of just those are joined and compared, a
batch at a time. Both ways give the same rows.

Defined results: null and short texts have no fingerprints and no leaks; rows without an id don't count, of an id with several texts
the longest shared span is reported; words are compared by 64-bit hashes. An item that is repeated under several ids is reported under each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text_arrays import chunks, grams, words
from pressmill.session import materialize

SHARED, K = 12, 7
MOST_HELD_OUT_WORDS, SALT = 4_000_000, 8
FOUND = "doc_id long, item_id long, words long"


def winnow(h: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Indices of the kept fingerprints: the rightmost smallest hash of every window within one text."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.diff(np.append(text, -1)))
    begin = np.concatenate(([0], ends[:-1] + 1))
    best = np.arange(n)
    for j in range(1, window):
        ahead = np.minimum(np.arange(n) + j, n - 1)
        better = (text[ahead] == text) & (h[ahead] <= h[best])
        best[better] = ahead[better]
    last = np.repeat(ends, ends - begin + 1) - np.arange(n)
    size = np.repeat(ends - begin + 1, ends - begin + 1)
    full = (last >= window - 1) | (size < window) & (np.arange(n) == np.repeat(begin, ends - begin + 1))
    return np.unique(best[full])


class HeldOut:
    """The items' words, laid end to end, and their fingerprints in order of hash."""

    def __init__(self, ids: list[int], texts: list[str | None], shared: int, k: int):
        w = words(texts)
        h, at = grams(w, k)
        kept = winnow(h, w.text[at], shared - k + 1)
        order = np.argsort(h[kept], kind="stable")
        self.hash, self.at = h[kept][order], at[kept][order]
        self.word, self.item, self.ids = w.hash, w.text, np.array(ids, np.int64)


_built: list[tuple] = []


def _held_out(value: tuple, shared: int, k: int) -> HeldOut:
    """Built once in each worker process for a broadcast value."""
    if not _built or _built[0][0] is not value or _built[0][1:3] != (shared, k):
        _built[:] = [(value, shared, k, HeldOut(*value, shared, k))]
    return _built[0][3]


def _run(a: np.ndarray, ta: np.ndarray, i: np.ndarray, b: np.ndarray, tb: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places i and j on, going by step, within one text on each side."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + step * n[live], j[live] + step * n[live]
        ok = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
        live, x, y = live[ok], x[ok], y[ok]
        same = (a[x] == b[y]) & (ta[x] == ta[i[live]]) & (tb[y] == tb[j[live]])
        live = live[same]
        n[live] += 1
    return n


def hits(doc_ids: np.ndarray, texts: list[str | None], held: HeldOut, shared: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, longest shared span in words) of a chunk of documents."""
    w = words(texts)
    h, at = grams(w, k)
    kept = winnow(h, w.text[at], shared - k + 1)
    h, at = h[kept], at[kept]
    lo, hi = np.searchsorted(held.hash, h, "left"), np.searchsorted(held.hash, h, "right")
    n = hi - lo
    i = np.repeat(at, n)
    j = held.at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    length = _run(w.hash, w.text, i, held.word, held.item, j, 1) + _run(w.hash, w.text, i, held.word, held.item, j, -1) - 1
    good = length >= shared
    return doc_ids[w.text[i[good]]], held.ids[held.item[j[good]]], length[good]


def leaks(docs: DataFrame, items: DataFrame, shared: int = SHARED, k: int = K, most_words: int = MOST_HELD_OUT_WORDS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) to (doc_id, item_id, words): pairs that share at least ``shared`` words in a row."""
    docs = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    items = items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    spark = docs.sparkSession
    # a word takes at least two bytes of text with the blank behind it
    size = items.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    if size > 2 * most_words:
        return _leaks_by_join(docs, items, shared, k)
    rows = items.collect()
    sent = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def find(batches):
        held = _held_out(sent.value, shared, k)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s, e in chunks(texts):
                d, i, n = hits(ids[s:e], texts[s:e], held, shared, k)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "words"])

    return docs.mapInArrow(find, FOUND).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _fingerprints(rows: DataFrame, shared: int, k: int) -> DataFrame:
    """rows(key, text) to (key, h)."""

    def find(batches):
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s, e in chunks(texts):
                w = words(texts[s:e])
                h, at = grams(w, k)
                kept = winnow(h, w.text[at], shared - k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[s:e][w.text[at[kept]]], pa.int64()), pa.array(h[kept].view(np.int64))], ["key", "h"])

    return rows.select("key", "text").mapInArrow(find, "key long, h long").distinct()


def _leaks_by_join(docs: DataFrame, items: DataFrame, shared: int, k: int) -> DataFrame:
    # a text is known by the hash of it and its id, so that an id may have several
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    i = items.select("item_id", F.col("text").alias("item_text"), F.xxhash64("item_id", "text").alias("item_key"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt")
    ours = _fingerprints(d, shared, k).select("key", "h", salt)
    theirs = _fingerprints(i.select(F.col("item_key").alias("key"), F.col("item_text").alias("text")), shared, k).select(F.col("key").alias("item_key"), "h", F.explode(F.array(*[F.lit(x) for x in range(SALT)])).alias("salt"))
    pairs = materialize(ours.join(theirs, ["h", "salt"]).select("key", "item_key").distinct(), "leak-candidates")
    both = pairs.join(d.dropDuplicates(["key"]), "key").join(i.dropDuplicates(["item_key"]), "item_key").select("key", "doc_id", "text", "item_id", "item_text")

    def compare(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # each text of the batch once; what else they share is a leak just as well
            rows = b.to_pydict()
            texts = list({x: (x, y, z) for x, y, z in zip(rows["key"], rows["doc_id"], rows["text"])}.values())
            held = dict(zip(zip(rows["item_id"], rows["item_text"]), rows["item_id"]))
            h = HeldOut(list(held.values()), [t for _, t in held], shared, k)
            for s, e in chunks([t for _, _, t in texts]):
                found = hits(np.array([x for _, x, _ in texts[s:e]]), [t for _, _, t in texts[s:e]], h, shared, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc_id", "item_id", "words"])

    return both.mapInArrow(compare, FOUND).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
