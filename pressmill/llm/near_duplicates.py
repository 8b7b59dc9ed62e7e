"""Near-duplicate documents: an exact join of signatures under a Hamming distance, and an exact check of what it finds.

A document is the set of its runs of WIDTH consecutive words. Its signature has c chunks of w minima of that set under random
orders, so two documents of similarity s differ in each symbol with probability 1 - s. The join is multi-index: by
pigeonhole, signatures at distance of at most c * (ERRORS + 1) - 1 have a chunk with at most ERRORS differing symbols, and
each way to leave ERRORS symbols out of a chunk is one key. All pairs under that distance are found for certain; of pairs
beyond it a chunk still agrees with probability 1 - (1 - p)^c, where p = P(Binomial(w, 1 - s) <= ERRORS). ``layout`` takes the
longest chunks, and so the most selective keys, for which a pair just at ``similarity`` is missed with probability MISS at
most and a document has at most MOST_KEYS keys: 17 chunks of 5 for 0.6, 10 of 8 for 0.8. Candidates whose whole signatures are farther apart than SPREAD standard
deviations above the distance expected of ``similarity`` are dropped, all others are compared set by set.

Documents with the same set are one class, and only class representatives are joined, so that a group of copies costs what
one document costs. Keys are sorted once, and each run of equal keys gives its pairs; a run of more than HOT is cut into blocks of
that size, and each pair of blocks is a group of its own, so that no key is too much for a task and no pair is left out. The only rows
that carry sets are those of candidates. ``links`` returns pairs of class representatives, ``pairs`` expands them over the members, ``groups``
has a row per document.

Defined results: null titles count as empty; null or blank contents, and texts of fewer than WIDTH words, have no set and
pair with nothing, but short texts of the same words are one class and other such documents a class each; repeated rows of an id count once, rows without an id not at all. Sets are compared by 48-bit hashes.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text_arrays import chunks, grams, mix, words
from pressmill.session import materialize, temporary

WIDTH, ERRORS, MISS, MOST_KEYS = 5, 1, 1e-3, 90
SIMILARITY, SPREAD, HOT = 0.8, 4.5, 256
_LOW = np.uint64((1 << 48) - 1)


def layout(similarity: float) -> tuple[int, int]:
    """(chunks, symbols of each)."""
    best = None
    for w in range(ERRORS + 2, 40):
        p = sum(comb(w, k) * (1 - similarity) ** k * similarity ** (w - k) for k in range(ERRORS + 1))
        chunks_n = 1 if p >= 1 else ceil(log(MISS) / log(1 - p))
        if chunks_n * comb(w, ERRORS) > MOST_KEYS and best:
            break
        best = (chunks_n, w)
    return best


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 48-bit hash) of the distinct shingles, in order; texts are at most 65,536."""
    w = words(texts)
    h, at = grams(w, width)
    key = np.unique((w.text[at].astype(np.uint64) << np.uint64(48)) | (h & _LOW))
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW


def _signatures(text: np.ndarray, h: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and a row of minima for each."""
    begin = np.flatnonzero(np.append(True, np.diff(text) > 0)[: len(text)])
    x = mix(h)
    a = mix(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((symbols, len(begin)), np.uint32)
    for k in range(symbols):
        out[k] = np.minimum.reduceat(((x * a[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return text[begin], out.T


def _keys(signature: np.ndarray, chunks_n: int, symbols: int, errors: int) -> np.ndarray:
    """A row of keys per signature: for each chunk every choice of symbols - errors symbols of it."""
    n, out = len(signature), []
    s = signature.reshape(n, chunks_n, symbols).astype(np.uint64)
    for number, kept in enumerate(combinations(range(symbols), symbols - errors)):
        salt = mix(np.arange(chunks_n, dtype=np.uint64) + np.uint64(1000 * (number + 1)))
        h = np.broadcast_to(salt, (n, chunks_n)).copy()
        for j in kept:
            h = mix(h + s[:, :, j])
        out.append(h)
    return np.concatenate(out, axis=1)


def _text(title: str | None, content: str | None) -> str | None:
    return None if content is None or not content.strip() else f"{title or ''} {content}"


def _word_classes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's words in order, and which texts have words."""
    w = words(texts)
    place = np.arange(len(w.hash)) - w.first[w.text]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix(place + 7)))))
    return mix(sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64), w.first[1:] > w.first[:-1]


def signed(docs: DataFrame, width: int, chunks_n: int, symbols: int, errors: int = ERRORS) -> DataFrame:
    """docs(id, title, content) to (id, cls, n, sketch, keys): the class of equal sets, the set's size, a byte of each symbol, the keys.

    Texts without a set have n = 0, no keys, and the class of their words in order, null if there are none.
    """

    def sign(batches):
        for b in batches:
            texts = [_text(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            for s, e in chunks(texts):
                text, h = shingles(texts[s:e], width)
                rest = np.setdiff1d(np.arange(e - s), text)
                if len(rest):
                    cls, some = _word_classes([texts[s + k] for k in rest.tolist()])
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(rest) + 1, np.int32)), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rest + s)), pa.array(cls, mask=~some), pa.array(np.zeros(len(rest), np.int32)), pa.nulls(len(rest), pa.binary()), none], ["id", "cls", "n", "sketch", "keys"])
                if not len(text):
                    continue
                who, signature = _signatures(text, h, chunks_n * symbols)
                begin = np.flatnonzero(np.append(True, np.diff(text) > 0))
                n = np.diff(np.append(begin, len(text)))
                cls = mix(np.add.reduceat(mix(h + np.uint64(1)), begin) ^ mix(n.astype(np.uint64)))
                keys = _keys(signature, chunks_n, symbols, errors)
                sketch = pa.array([r.tobytes() for r in signature.astype(np.uint8)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who + s)), pa.array(cls.view(np.int64)), pa.array(n, pa.int32()), sketch, lists], ["id", "cls", "n", "sketch", "keys"])

    return docs.select("id", "title", "content").mapInArrow(sign, "id string, cls long, n int, sketch binary, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """docs(cls, title, content) to (cls, n, members): the sets themselves."""

    def collect(batches):
        for b in batches:
            texts = [_text(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            for s, e in chunks(texts):
                text, h = shingles(texts[s:e], width)
                n = np.bincount(text, minlength=e - s)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(n, pa.int32()), lists], ["cls", "n", "members"])

    return docs.select("cls", "title", "content").mapInArrow(collect, "cls long, n int, members array<long>")


def _close(candidates: DataFrame, most: int) -> DataFrame:
    """The rows (a, b, x, y) whose sketches x and y differ in at most ``most`` symbols."""

    def compare(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
                keep = pa.array((x != y).sum(1) <= most)
                yield b.select([0, 1]).filter(keep)

    return candidates.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _pairs_of_runs(key: np.ndarray, cls: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of classes with equal keys, of sizes that allow the similarity; keys are in order."""
    behind = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    one = np.repeat(np.arange(len(key)), behind)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(behind) - behind, behind)
    near = (cls[one] != cls[two]) & (n[one] >= similarity * n[two]) & (n[two] >= similarity * n[one])
    a, b = cls[one[near]], cls[two[near]]
    return np.minimum(a, b), np.maximum(a, b)


_COLLIDING = "a long, b long, key long, n int"


def _runs(similarity: float, hot: int):
    """For sorted (key, cls, n): the pairs of each run of equal keys; rows (cls, null, key, n) of runs longer than ``hot``."""

    def emit(a, b, key, n):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64()), pa.array(n, pa.int32()) if n is not None else pa.nulls(len(a), pa.int32())], ["a", "b", "key", "n"])

    def find(batches):
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
        over = None  # the key of a run that is known to be longer
        for b in batches:
            key, cls, n = (np.concatenate((h, b.column(c).to_numpy())) for c, h in enumerate(held))
            if not len(key):
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(starts, len(key)))
            long = (size > hot) | (key[starts] == over if over is not None else False)
            tail = starts[-1]
            over = key[-1] if long[-1] else None
            rows = np.repeat(long, size)
            done = np.arange(len(key)) < (len(key) if long[-1] else tail)
            pick = rows & done
            if pick.any():
                yield from emit(cls[pick], None, key[pick], n[pick])
            pick = ~rows & done & np.repeat(size > 1, size)
            if pick.any():
                yield from emit(*_pairs_of_runs(key[pick], cls[pick], n[pick], similarity), None, None)
            held = tuple(x[done.sum() :] for x in (key, cls, n))
        if len(held[0]) > 1:
            yield from emit(*_pairs_of_runs(*held, similarity), None, None)

    return find


def colliding(keyed: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """keyed(key, cls, n) to (a, b), a < b: the classes that share a key; a pair may come several times."""
    runs = keyed.select("key", "cls", F.col("n").cast("int").alias("n")).repartition("key").sortWithinPartitions("key")
    found = materialize(runs.mapInArrow(_runs(similarity, hot), _COLLIDING), "collisions")
    rows = found.where("b IS NULL").select("key", F.col("a").alias("cls"), "n")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
    own = rows.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    grid = own.select("key", "cls", "n", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    grid = grid.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("first"), "cls", "n")

    def pairs(t: pa.Table) -> pa.Table:
        cls, n = t["cls"].to_numpy(), t["n"].to_numpy()
        if t["i"][0] == t["j"][0]:
            a, b = _pairs_of_runs(np.zeros(len(cls), np.int64), cls, n, similarity)
            return pa.table({"a": pa.array(a), "b": pa.array(b)})
        first = t["first"].to_numpy()
        one, two = np.flatnonzero(first), np.flatnonzero(~first)
        one, two = np.repeat(one, len(two)), np.tile(two, len(one))
        near = (n[one] >= similarity * n[two]) & (n[two] >= similarity * n[one])
        a, b = cls[one[near]], cls[two[near]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return found.where("b IS NOT NULL").select("a", "b").unionByName(grid.groupBy("key", "i", "j").applyInArrow(pairs, "a long, b long"))


def classes_and_links(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members(id, cls, n), links(a, b, similarity)) where a < b are classes of different sets; n is the set's size, 0 without one."""
    chunks_n, symbols = layout(similarity)
    total, docs = chunks_n * symbols, docs.where("id IS NOT NULL").select(F.col("id").cast("string"), "title", "content")
    with temporary() as keep:
        sign = materialize(signed(docs, width, chunks_n, symbols).withColumn("row", F.monotonically_increasing_id()), "signatures")
        members = materialize(sign.select("id", "cls", "n").distinct(), "members")
        sign = sign.where("n > 0")
        # every class but for its first row leaves the join; where classes have one row each, nothing is shuffled for that
        several = sign.groupBy("cls").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
        others = materialize(sign.select("row", "cls").join(several, "cls").where("row <> first").select("row"), "others")
        once = sign.join(others, "row", "left_anti")
        keyed = once.select(F.explode("keys").alias("key"), "cls", "n")
        candidates = materialize(colliding(keyed, similarity).distinct(), "candidates")
        sketched = candidates.join(once.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(once.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
        most = int(total * (1 - similarity) + SPREAD * (total * similarity * (1 - similarity)) ** 0.5 + 1)
        pairs = materialize(_close(sketched, most), "close")
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        chosen = materialize(once.select("id", "cls").join(wanted, "cls"), "chosen")
        sets = materialize(_sets(docs.join(chosen, "id").dropDuplicates(["cls"]), width), "sets")
        both = (
            pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb")), "b")
            .withColumn("common", F.size(F.array_intersect("ma", "mb")))
        )
        found = both.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))
        links = materialize(found.where(F.col("similarity") >= similarity), "links")
        keep(members)
        keep(links)
    return members, links


def pairs(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids, copies included."""
    members, links = classes_and_links(docs, width, similarity)
    members = members.where("n > 0")
    one, two = members.select(F.col("id").alias("x"), F.col("cls").alias("a")), members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two, one.a == two.b).where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: (id, class_id, copies, links); links counts documents of other texts, class_id is the smallest id of the class."""
    members, links = classes_and_links(docs, width, similarity)
    size = members.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = both.join(size.select(F.col("cls").alias("other"), F.col("copies").alias("others")), "other").groupBy("cls").agg(F.sum("others").alias("links"))
    own = members.select("id", "cls").join(size, "cls", "left").join(degree, "cls", "left")
    return own.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
