"""The most similar vectors of every vector: stable random projections in kd-trees, verified until a chi-square test holds.

Unit vectors are projected onto Gaussian directions. A difference of projections is normal with the vectors' distance as deviation, and
the squared distance of m of them is the squared distance times a chi-square variable.

Coarse trees spread the vectors: level d of a tree cuts its d-th direction at the median, estimated on about SAMPLE vectors of a model, until
a cell holds about CELL vectors. Every vector lies in one cell of each tree, and looks for neighbours in the cells where one within its radius lies with
probability ``sure`` together, the likeliest first: crossing a cut costs the normal tail beyond it. From MANY_LEVELS levels on there are
several trees with a lesser share of that probability each, which takes fewer cells in all (a vector goes to about 4 cells of 8, 36 of 1,024, 180 of
131,072: work grows with the vectors to the power of about 1.3). Cells are split by what is counted to arrive in them, vectors and queries each, so that no task gets more
than about BLOCK of either, however unevenly they are spread.

In a cell, a kd-tree over INDEXED further projections gives the leaves in order of projected distance from the queries; what passes the test on
DIMENSIONS projections is compared exactly, in double; and once the next leaf is so far that a vector closer than the k-th best one
found would lie within with probability ``sure``, the search stops. Only vectors with a cosine of at least ``floor`` are wanted; with floor None each
query searches its own cell first, and its k-th best there is its radius for the others.

Equal vectors are one class: a class is searched once, and since ties go to the smaller id, only its k + 1 smallest ids can be
anybody's neighbours. So copies of one vector cost no more than that, however many there are.

Defined results: vectors that are null, of another length, with nulls or values that aren't finite, or all zero, or without an id take no part; an id
that comes with several vectors has the one with the smallest hash; a model of one vector has no neighbours.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions.projections import CROSSED, cells, directions, probes, tail, unit  # noqa: F401
from pressmill.llm.text_arrays import mix
from pressmill.session import materialize, release

INDEXED, DIMENSIONS, SAMPLE, CELL, BLOCK, LEAF = 8, 16, 20_000, 8192, 32_768, 256
SURE, MANY_LEVELS = 0.999, 6


def chi_square(x: float, m: int) -> float:
    """Distribution function of an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


@lru_cache(64)
def quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable(embedding: str, dim: int) -> Column:
    return F.expr(f"size({embedding}) = {dim} AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({embedding}, x -> x <> 0)")


def _leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    out, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        q = p[rows]
        d = int((q.max(0) - q.min(0)).argmax())
        order = rows[np.argpartition(q[:, d], len(rows) // 2)]
        stack += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def nearest(query: np.ndarray, data: np.ndarray, k: int, farthest: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data, cosine) of the k best of each query among unit vectors, up to a squared distance each; ties go to the smaller place in data."""
    g = directions(data.shape[1], -1, DIMENSIONS)
    pq, pd = (query @ g).astype(np.float32), (data @ g).astype(np.float32)
    # the squared distance of two projections as one product
    lq, ld = np.concatenate((-2 * pq, (pq * pq).sum(1, keepdims=True), np.ones((len(pq), 1), np.float32)), 1), np.concatenate((pd, np.ones((len(pd), 1), np.float32), (pd * pd).sum(1, keepdims=True)), 1)
    leaves = _leaves(pd[:, :INDEXED], LEAF)
    lo, hi = (np.stack([f(pd[x, :INDEXED], axis=0) for x in leaves]).astype(np.float64) for f in (np.min, np.max))
    t_index, t_all = quantile(sure, INDEXED), quantile(sure, DIMENSIONS)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in _leaves(pq[:, :INDEXED], LEAF) if len(pq) else []:
        p = pq[rows]
        a, b = p[:, :INDEXED].min(0), p[:, :INDEXED].max(0)
        gap = (np.maximum(np.maximum(lo - b, a - hi), 0) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        worst = farthest[rows].copy()  # squared distance that a further neighbour may have
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, step = 0, 4
        while at < len(order) and gap[order[at]] <= t_index * worst.max():
            batch = order[at : at + step]
            batch = batch[gap[batch] <= t_index * worst.max()]
            at, step = at + step, min(step * 2, 16)
            near = np.concatenate([leaves[x] for x in batch])
            d2 = lq[rows] @ ld[near].T
            i, j = np.divmod(np.flatnonzero(d2 <= (t_all * worst + 1e-3).astype(np.float32)[:, None]), len(near))
            if len(i) > 0.1 * d2.size:
                cosine = (query[rows] @ data[near].T)[i, j]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", query[rows[i[s : s + 65_536]]], data[near[j[s : s + 65_536]]]) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
            good = 2 - 2 * cosine <= worst[i] + 1e-12
            if not good.any():
                continue
            q, d, c = (np.concatenate(x) for x in zip(found, (i[good], near[j[good]], cosine[good])))
            rank = np.lexsort((d, -c, q))
            q, d, c = q[rank], d[rank], c[rank]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            found = (q[keep], d[keep], c[keep])
            last = place == k - 1
            worst[q[last]] = np.minimum(worst[q[last]], np.maximum(0, 2 - 2 * c[last]))
        out.append((rows[found[0]], found[1], found[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_ROUTED = "cls long, model string, ids array<string>, embedding array<float>, radius double, part long, query boolean"
_FOUND = "cls long, other long, ids array<string>, cosine double"


def coarse_trees(classes: DataFrame, dim: int) -> dict[str, list[np.ndarray]]:
    """Of each model its trees, each as the medians of its cuts: more levels and trees the more vectors there are."""
    trees = {}
    for model, n in sorted((r["model"], r["n"]) for r in classes.groupBy("model").agg(F.count("*").alias("n")).collect()):
        levels = max(0, math.ceil(math.log2(n / CELL)))
        some = classes.where((F.col("model") == model) & (F.pmod("cls", F.lit(10**15)) < min(1.0, SAMPLE / n) * 10.0**15)).limit(2 * SAMPLE)
        x = unit(_matrix(some.select("embedding").toArrow()["embedding"], dim)) if levels else None
        trees[model] = [np.median(x @ directions(dim, t, levels), axis=0) if levels else np.zeros(0) for t in range(max(1, levels - MANY_LEVELS + 1))]
    return trees


def _routes(b: pa.RecordBatch, trees: dict[str, list[np.ndarray]], dim: int, sure: float, home: bool | None):
    """(model, tree, rows, their cells, asking rows, the cells they look into); home: only the own cell, or all but that."""
    x = unit(_matrix(b.column(3), dim))
    models, radius = np.array(b.column(1).to_pylist(), object), b.column(4).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for model in sorted(set(models)):
        rows = np.flatnonzero(models == model)
        asking = np.flatnonzero(~np.isnan(radius[rows]))
        for t, cuts in enumerate(trees[model]):
            place = x[rows] @ directions(dim, t, len(cuts)) - cuts
            own = cells(place)
            if home:
                q, cell = asking, own[asking]
            else:
                q, cell = probes(place[asking], np.sqrt(radius[rows][asking]), 1 - (1 - sure) ** (1 / len(trees[model])))
                q = asking[q]
                if home is False:
                    q, cell = q[cell != own[q]], cell[cell != own[q]]
            yield model, t, rows, own, rows[q], cell


def _search(classes: DataFrame, trees: dict[str, list[np.ndarray]], k: int, dim: int, sure: float, home: bool | None = None) -> DataFrame:
    """classes(cls, model, ids, embedding, radius) to (cls, other, ids, cosine): up to k others within the squared distance ``radius``, of each class that has one."""

    def count(batches):
        for b in batches:
            if b.num_rows:
                for model, t, _, own, _, cell in _routes(b, trees, dim, sure, home):
                    (c, n), (d, m) = np.unique(own, return_counts=True), np.unique(cell, return_counts=True)
                    size = len(c) + len(d)
                    yield pa.RecordBatch.from_arrays([pa.array([model] * size), pa.array([t] * size, pa.int32()), pa.array(np.append(c, d)), pa.array(np.append(n, np.zeros_like(m))), pa.array(np.append(np.zeros_like(n), m))], ["model", "tree", "cell", "vectors", "queries"])

    counted = classes.select("cls", "model", "ids", "embedding", "radius").mapInArrow(count, "model string, tree int, cell long, vectors long, queries long")
    # a row per cell, which are one for CELL vectors
    blocks, parts = {}, 0
    for r in counted.groupBy("model", "tree", "cell").agg(F.sum("vectors").alias("v"), F.sum("queries").alias("q")).where("v > 0 AND q > 0").orderBy("model", "tree", "cell").collect():
        v, q = -(-r["v"] // BLOCK), -(-r["q"] // BLOCK)
        blocks[r["model"], r["tree"], r["cell"]] = (parts, v, q)
        parts += v * q

    def route(batches):
        names = ["cls", "model", "ids", "embedding", "radius", "part", "query"]
        for b in batches:
            if not b.num_rows:
                continue
            cls = mix(b.column(0).to_numpy().astype(np.uint64))
            for model, t, rows, own, asking, cell in _routes(b, trees, dim, sure, home):
                for role, who, where in ((False, rows, own), (True, asking, cell)):
                    kinds, which = np.unique(where, return_inverse=True)
                    at = np.array([blocks.get((model, t, int(c)), (0, 0, 0)) for c in kinds], np.int64).reshape(-1, 3)[which]
                    first, v, q = at[:, 0], np.maximum(at[:, 1], 1), np.maximum(at[:, 2], 1)
                    fixed = (cls[who] % (q if role else v).astype(np.uint64)).astype(np.int64)
                    n = np.where(at[:, 1] > 0, v if role else q, 0)
                    each = np.repeat(np.arange(len(who)), n)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    part = first[each] + (other * q[each] + fixed[each] if role else fixed[each] * q[each] + other)
                    for s in range(0, len(each), 20_000):
                        take = pa.array(who[each[s : s + 20_000]])
                        some = [b.column(c).take(take) for c in range(5)]
                        if role:
                            some[2] = pa.nulls(len(take), some[2].type)
                        yield pa.RecordBatch.from_arrays([*some, pa.array(part[s : s + 20_000]), pa.array(np.full(len(take), role))], names)

    def search(t: pa.Table) -> pa.Table:
        role = t["query"].to_numpy()
        data, query = t.filter(pa.array(~role)), t.filter(pa.array(role))
        data = data.take(pa.array(np.argsort(np.array([x[0] for x in data["ids"].to_pylist()], object)))) if len(data) else data
        if len(data) and len(query):
            q, d, c = nearest(unit(_matrix(query["embedding"], dim)), unit(_matrix(data["embedding"], dim)), k, query["radius"].to_numpy(), sure)
        else:
            q = d = np.zeros(0, np.int64)
            c = np.zeros(0)
        return pa.table({"cls": query["cls"].take(pa.array(q)), "other": data["cls"].take(pa.array(d)), "ids": data["ids"].take(pa.array(d)), "cosine": pa.array(c)})

    routed = classes.select("cls", "model", "ids", "embedding", "radius").mapInArrow(route, _ROUTED)
    found = routed.groupBy("part").applyInArrow(search, _FOUND)
    return found.dropDuplicates(["cls", "other"]) if any(len(t) > 1 for t in trees.values()) else found


def neighbours(vectors: DataFrame, k: int = 5, floor: float | None = None, dim: int = 64, queries: str | None = None, sure: float = SURE) -> DataFrame:
    """vectors(id, model, embedding) to (id, neighbour, cosine, rank): the k highest cosines of each id, or of those that the condition ``queries`` picks."""
    own = vectors.where(usable("embedding", dim) & F.col("id").isNotNull()).withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    own = own.groupBy("id").agg(F.min(F.struct("h", "h2", "model", "embedding")).alias("v")).select("id", "v.*")
    own = materialize(own.withColumn("cls", F.xxhash64("model", "h", "h2")), "vectors")
    asked = own.where(queries) if queries else own
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = first.groupBy("cls").agg(F.first("model").alias("model"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("embedding", "id").alias("embedding"))
    radius = F.lit(4.0 if floor is None else 2 - 2 * floor)
    if queries:
        classes = classes.join(asked.select("cls").distinct().withColumn("radius", radius), "cls", "left")
    else:
        classes = classes.withColumn("radius", radius)
    members = materialize(asked.select("id", "cls"), "members")
    classes = materialize(classes.select("cls", F.coalesce("model", F.lit("")).alias("model"), "ids", "embedding", "radius"), "classes")
    release(own)
    trees = coarse_trees(classes, dim)
    if floor is None and any(len(t[0]) for t in trees.values()):
        here = materialize(_search(classes, trees, k + 1, dim, sure, home=True), "own-cells")
        best = here.groupBy("cls").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c"))
        narrowed = classes.drop("radius").join(best.select("cls", F.greatest(2 - 2 * F.coalesce(F.get("c", F.lit(k)), F.lit(-1.0)), F.lit(0.0)).alias("radius")), "cls", "left")
        got = here.unionByName(_search(materialize(narrowed, "narrowed"), trees, k + 1, dim, sure, home=False))
        got = got.dropDuplicates(["cls", "other"])
    else:
        got = _search(classes, trees, k + 1, dim, sure)
    best = Window.partitionBy("cls").orderBy(F.desc("cosine"), "neighbour")
    lists = got.select("cls", F.explode("ids").alias("neighbour"), "cosine").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    mine = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    out = members.join(lists.drop("r"), "cls").where("id <> neighbour").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    out = out if floor is None else out.where(F.col("cosine") >= floor)
    return out.select("id", "neighbour", "cosine", "rank")


def similar_pairs(vectors: DataFrame, k: int = 5, floor: float = 0.9, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with a cosine of at least floor, one of them among the other's k best."""
    n = neighbours(vectors, k, floor, dim)
    return n.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
