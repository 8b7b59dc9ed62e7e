"""Splitting oversized texts at natural boundaries, with overlap, by pointer doubling.

All boundaries of a chunk of texts are laid out as one array. Each is joined (by binary search) to its farthest legal
successor, the last boundary within LIMIT, and the table of successors is squared again and again; after k squarings the first 2^k
greedy cuts of every text are known, so that long texts take a logarithmic number of array operations and no loop over pieces.

That is done first for each kind of boundary by itself, without overlap: a boundary with no legal successor, because the unit behind
it exceeds LIMIT, leads to itself, and the kind of a text is the first of paragraph, line, sentence, word by whose table the
text's beginning reaches its end; none if none does. Then for the cuts themselves, where the next piece begins OVERLAP characters
before the boundary: where that leaves no room for the next unit, the cut falls back to a finer kind, and inside a run without
white space to a place every LIMIT - OVERLAP characters.

Defined results: texts of at most LIMIT characters (code points) and nulls yield no row; a text that is within the limit once
trimmed is one piece; one of nothing but white space is one empty piece of kind paragraph. Repeated rows of an id yield their
pieces once (such rows are taken to agree), rows without an id none. There is no shuffle but for that, of pieces only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text_arrays import chunks, code_points

LIMIT, OVERLAP = 4000, 200
KINDS = ("none", "word", "sentence", "line", "paragraph")
PIECES = "id string, piece int, begin int, length int, boundary string, text string"
_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)


@lru_cache(1)
def _white() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


def _inside(begin: np.ndarray, end: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs longer than step: the places every step characters within, and each place's run."""
    n = np.maximum(0, (end - begin - 1) // step)
    run = np.repeat(np.arange(len(begin)), n)
    return begin[run] + step * (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + 1), run


def squared(following: np.ndarray) -> np.ndarray:
    """Where each place leads in the end, by doubling: a place that leads to itself stays."""
    while True:
        twice = following[following]
        if (twice == following).all():
            return following
        following = twice


def cut(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, begin, length, kind) of all pieces of the texts."""
    codes, at = code_points(texts)
    solid = np.flatnonzero(~_white()[codes])
    owner = np.searchsorted(at, solid, "right") - 1
    feeds = np.concatenate(([0], np.cumsum(codes == 10)))
    # a run of characters without white space ends where the next solid character isn't next to it
    last = np.flatnonzero(np.append((np.diff(solid) > 1) | (np.diff(owner) > 0), True)) if len(solid) else np.zeros(0, np.int64)
    run_end = solid[last] + 1
    run_begin = solid[np.concatenate(([0], last[:-1] + 1))] if len(last) else run_end
    doc = owner[last]
    final = np.append(np.diff(doc) > 0, True)[: len(doc)]
    gap = feeds[np.append(run_begin[1:], 0)] - feeds[run_end]
    stop = np.isin(codes[run_end - 1], _ENDS)
    rank = np.where(final | (gap >= 2), 4, np.where(gap == 1, 3, np.where(stop, 2, 1)))
    # the kind of each text: the first by whose boundaries alone its beginning leads to its end
    kind = np.full(len(texts), 4)
    for r, own in ((4, gap >= 2), (3, gap >= 1), (2, stop), (1, gap >= 0)):
        e = np.flatnonzero(own | final)  # the runs that end a unit
        b = np.concatenate(([0], e[:-1] + 1))[: len(e)]  # and those that begin it
        units, home = np.arange(len(e)), doc[e]
        opening = np.append(True, np.diff(home) > 0)[: len(e)]
        closing = np.searchsorted(home, home, "right") - 1
        reach = np.minimum(np.searchsorted(run_end[e], run_begin[b] + limit, "right") - 1, closing)
        behind = np.where(reach < units, units, np.where(reach == closing, len(e), reach + 1))
        stuck = squared(np.append(behind, len(e)))[:-1] < len(e)
        over = np.zeros(len(texts), bool)
        over[home[opening & stuck]] = True
        kind[over & (kind == r)] = r - 1
    # boundaries in order of place; where two are more than a step apart, with places in between
    behind = np.where(np.append(False, doc[1:] == doc[:-1])[: len(doc)], np.append(0, run_end[:-1])[: len(doc)], run_begin)
    place, run = _inside(behind, run_end, max(1, limit - overlap))
    node = np.concatenate((run_end, place))
    order = np.argsort(node, kind="stable")
    node, node_rank, node_doc = node[order], np.concatenate((rank, np.zeros(len(place), np.int64)))[order], np.concatenate((doc, doc[run]))[order]
    n = len(node)
    first = np.searchsorted(node_doc, np.arange(len(texts)))
    end = np.searchsorted(node_doc, np.arange(len(texts)), "right") - 1
    some = end >= first
    begin = np.zeros(len(texts), np.int64)
    begin[doc[::-1]] = run_begin[::-1]

    def farthest(after: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The last boundary behind ``after`` up to start + limit, of the text's kind if possible, else of a finer one."""
        out = np.full(len(after), -1)
        reach = np.minimum(start + limit, node[end[which]])
        for r in (4, 3, 2, 1, 0):
            own = np.flatnonzero(node_rank >= r)
            k = np.searchsorted(node[own], reach, "right") - 1
            got = own[np.maximum(k, 0)]
            fits = (k >= 0) & (node[got] > after) & (out < 0) & (kind[which] >= r)
            out[fits] = got[fits]
        return out

    texts_with = np.flatnonzero(some)
    entry = farthest(begin[texts_with], begin[texts_with], texts_with) if n else np.zeros(0, np.int64)
    following = farthest(node, np.maximum(node - overlap, begin[node_doc]), node_doc) if n else np.zeros(0, np.int64)
    following = np.where(np.arange(n) == end[node_doc], np.arange(n), following) if n else following
    reached = np.zeros(n, bool)
    reached[entry] = True
    while n:
        new = following[reached]
        if reached[new].all():
            break
        reached[new] = True
        following = following[following]
    ends = np.flatnonzero(reached)
    who = node_doc[ends]
    opening = np.append(True, np.diff(who) > 0)[: len(who)]
    starts = np.where(opening, begin[who], np.concatenate(([0], node[ends[:-1]] - overlap))[: len(who)])
    starts = np.maximum(starts, begin[who])
    piece = np.arange(len(who)) - np.maximum.accumulate(np.where(opening, np.arange(len(who)), 0)) if len(who) else who
    empty = np.flatnonzero(~some)
    z = np.zeros(len(empty), np.int64)
    return tuple(np.concatenate(x) for x in ((who, empty), (piece, z), (starts - at[who], z), (node[ends] - starts, z), (kind[who], kind[empty])))


def split_texts(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """docs(id, content) to (id, piece, begin, length, boundary[, text]): offsets in characters, and the text, of each piece of the longer texts."""

    def pieces(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for s, e in chunks(texts):
                who, piece, begin, length, kind = cut(texts[s:e], limit, overlap)
                text = [texts[s + w][x : x + n] for w, x, n in zip(who.tolist(), begin.tolist(), length.tolist())] if with_text else None
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(who + s)), pa.array(piece, pa.int32()), pa.array(begin, pa.int32()), pa.array(length, pa.int32()), pa.array([KINDS[k] for k in kind], pa.string()),
                        pa.array(text, pa.string()) if with_text else pa.nulls(len(who), pa.string()),
                    ],
                    ["id", "piece", "begin", "length", "boundary", "text"],
                )

    long = docs.where((F.char_length("content") > limit) & F.col("id").isNotNull()).select(F.col("id").cast("string"), "content")
    out = long.mapInArrow(pieces, PIECES)
    return (out if with_text else out.drop("text")).dropDuplicates(["id", "piece"])


def rejoined(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, within, overlapping, text) of pieces with text: whether all are within the limit and overlap as asked, and what they say without the overlaps."""
    each = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "begin", "length", "text"))).alias("p"))
    shared = "p[i - 2].begin + p[i - 2].length - p[i - 1].begin"
    return each.select(
        "id", F.expr(f"forall(p, x -> x.length <= {limit} AND x.length = char_length(x.text))").alias("within"),
        F.expr(f"forall(sequence(1, size(p)), i -> i = 1 OR {shared} = {overlap})").alias("overlapping"),
        F.expr(f"array_join(transform(sequence(1, size(p)), i -> if(i = 1, p[0].text, substring(p[i - 1].text, {shared} + 1))), '')").alias("text"),
    )
