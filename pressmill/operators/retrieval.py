"""Search over articles without an index: one plan of scan, filter, score and top-k; only ids and scores are ordered.

This reads all texts for each query; ``index`` has the same search over stored postings. Term counts come from each row's own tokens;
what is shuffled to count repeated rows of an id once are those counts, never texts. The corpus statistics of BM25 are one global
aggregate (a row). Article columns are joined to the k best ids afterwards. Defined results: null fields are empty; repeated rows of an id count
once; ties go to the larger id.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import text as A
from pressmill.operators import boolean
from pressmill.session import materialize

FIELDS = ("title", "description", "content")
ALL_FIELDS = (*FIELDS, "subtitle", "author")
LABELS = {"title": "A", "description": "B", "content": "C", "subtitle": "D", "author": "D"}
K1, B, AUTO = 1.2, 0.75, -1
PAGE_DEFAULT, PAGE_MOST, MOST_SLOP, RRF_K, CANDIDATES = 100, 10_000, 3, 60, 200


@dataclass(frozen=True)
class Match:
    """Terms in some fields; operator "and" or "or"; weights per field; fuzziness in edits per term, or AUTO by its length."""

    text: str
    fields: tuple[str, ...] = FIELDS
    operator: str = "or"
    weights: dict[str, float] = field(default_factory=dict)
    best_fields: bool = False
    fuzziness: int = 0


@dataclass(frozen=True)
class Phrase:
    text: str
    fields: tuple[str, ...] = FIELDS
    slop: int = 0


@dataclass(frozen=True)
class Boolean:
    expression: str
    fields: tuple[str, ...] = FIELDS


def parse_field(spec: str) -> tuple[str, float] | None:
    """``field^weight``: a bad weight counts 1, more than one mark makes the field void."""
    name, *rest = spec.split("^")
    if len(rest) > 1:
        return None
    try:
        return name, float(rest[0]) if rest else 1.0
    except ValueError:
        return name, 1.0


def fields_of(labels: str) -> tuple[str, ...]:
    """The fields that have one of the labels; D stands for two."""
    if unknown := set(labels) - set(LABELS.values()):
        raise ValueError(f"unknown label {sorted(unknown)[0]}")
    return tuple(f for f in ALL_FIELDS if LABELS[f] in labels)


def label_weights(weights: dict[str, float]) -> list[float]:
    """Weights of D, C, B and A from those of fields; the greater one where two fields share a label, 0 for a label without one."""
    return [max((w for f, w in weights.items() if LABELS.get(f) == x), default=0.0) for x in "DCBA"]


def articles_once(articles: DataFrame, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per id."""
    return articles.groupBy("id").agg(*[F.max(c).alias(c) for c in columns])


def analyzed(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id and the tokens of each field."""
    return docs.select("id", *[A.tokens(F.col(f)).alias(f) for f in fields])


def words_of(text: str) -> list[str]:
    return list(dict.fromkeys(w for n in [boolean.lex(text)] for _, v in n for w in v.lower().split()))


def edits(term: str, fuzziness: int) -> int:
    """Edits allowed for a term: none up to two characters, one up to five, two beyond, where fuzziness is AUTO."""
    return (len(term) > 2) + (len(term) > 5) if fuzziness == AUTO else fuzziness


def _counts(toks: Column, terms: list[str], fuzziness: int) -> list[Column]:
    close = lambda t, n: lambda w: F.levenshtein(w, F.lit(t), n) >= 0
    return [F.size(F.filter(toks, close(t, edits(t, fuzziness)))) if edits(t, fuzziness) else A.term_count(toks, t) for t in terms]


def bm25(tf: Column, dl: Column, df: int, n: int, average: float, k1: float = K1, b: float = B) -> Column:
    idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (average or 1.0)))


def scored(docs: DataFrame, q: Match) -> DataFrame:
    """(id, score, matched): BM25 of every article, per field or summed, and whether the operator is satisfied."""
    terms = words_of(q.text)
    toks = analyzed(docs, q.fields)
    cols = []
    for f in q.fields:
        cols.append(F.size(f).alias(f"dl_{f}"))
        cols += [c.alias(f"tf_{f}_{i}") for i, c in enumerate(_counts(F.col(f), terms, q.fuzziness))]
    counted = toks.select("id", *cols)
    # a narrow table, written so that the texts are read and split once for the statistics and the scores
    counted = materialize(counted.groupBy("id").agg(*[F.max(c).alias(c) for c in counted.columns if c != "id"]), "counts")
    stats = counted.agg(
        F.count("*").alias("n"),
        *[F.avg(f"dl_{f}").alias(f"dl_{f}") for f in q.fields],
        *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f in q.fields for i in range(len(terms))],
    ).first()
    df = {(f, i): stats[f"df_{f}_{i}"] for f in q.fields for i in range(len(terms))}
    return scores(counted, q, len(terms), stats["n"], df, {f: stats[f"dl_{f}"] for f in q.fields})


def scores(counted: DataFrame, q: Match, terms: int, n: int, df: dict[tuple[str, int], int], average: dict[str, float]) -> DataFrame:
    """(id, score, matched) from lengths and term counts per field, and the collection's statistics."""
    per_field, hit = [], [F.lit(False)] * terms
    for f in q.fields:
        total = F.lit(0.0)
        for i in range(terms):
            tf = F.col(f"tf_{f}_{i}")
            total = total + bm25(tf, F.col(f"dl_{f}"), df[f, i], n, average[f])
            hit[i] = hit[i] | (tf > 0)
        per_field.append(total * q.weights.get(f, 1.0))
    score = per_field[0]
    if len(per_field) > 1:
        score = F.greatest(*per_field) if q.best_fields else sum(per_field[1:], per_field[0])
    matched = hit[0] if hit else F.lit(False)
    for h in hit[1:]:
        matched = (matched & h) if q.operator == "and" else (matched | h)
    return counted.select("id", A.round4(score).alias("score"), matched.alias("matched"))


def search(docs: DataFrame, q: Match) -> DataFrame:
    """(id, score) of the matching articles."""
    return scored(docs, q).where("matched").select("id", "score")


def phrase_words(q: Phrase) -> list[str]:
    if not 0 <= q.slop <= MOST_SLOP:
        raise ValueError(f"slop must be between 0 and {MOST_SLOP}")
    return [w for _, v in boolean.lex(q.text) for w in v.lower().split()]


def phrase_predicate(q: Phrase, toks: Column) -> Column:
    """Slop s: for some distance d up to s, every word is followed by the next at exactly d + 1 places."""
    words = phrase_words(q)
    if len(words) == 1:
        return F.array_contains(toks, words[0])
    if q.slop == 0:
        return A.has_phrase(toks, words)
    out = F.lit(False)
    for d in range(q.slop + 1):
        every = F.lit(True)
        for a, b in zip(words, words[1:]):
            every = every & F.coalesce(A.within_distance(toks, a, b, d + 1), F.lit(False))
        out = out | every
    return out


def match_phrase(docs: DataFrame, q: Phrase) -> DataFrame:
    """(id, fields): in how many of the fields the phrase occurs."""
    toks = analyzed(docs, q.fields)
    n = sum((F.coalesce(phrase_predicate(q, F.col(f)), F.lit(False)).cast("int") for f in q.fields), F.lit(0))
    return toks.select("id", n.alias("fields")).where("fields > 0").groupBy("id").agg(F.max("fields").alias("fields"))


def match_boolean(docs: DataFrame, q: Boolean) -> DataFrame:
    """(id) of the articles whose fields together satisfy the expression; phrases don't run across fields."""
    tree = boolean.parse(q.expression)
    together = F.concat(*[x for f in q.fields for x in (F.col(f), F.array(F.lit("\n")))])
    return analyzed(docs, q.fields).select("id", together.alias("all")).where(boolean.predicate(tree, F.col("all"))).select("id").distinct()


def page(hits: DataFrame, size: int = PAGE_DEFAULT, after: tuple[float, str] | None = None, most: int = PAGE_MOST) -> DataFrame:
    """The next ``size`` hits in order of score and id; ``after`` is the last hit of the page before."""
    if not 1 <= size <= most:
        raise ValueError(f"size must be between 1 and {most}")
    if after:
        s, i = after
        hits = hits.where((F.col("score") < s) | ((F.col("score") == s) & (F.col("id") < i)))
    return hits.orderBy(F.desc("score"), F.desc("id")).limit(size)


def probe(hits: DataFrame, size: int = PAGE_DEFAULT, after: tuple[float, str] | None = None) -> DataFrame:
    """A page and one hit more, which tells whether others follow."""
    if not 1 <= size <= PAGE_MOST:
        raise ValueError(f"size must be between 1 and {PAGE_MOST}")
    return page(hits, min(size + 1, PAGE_MOST + 1), after, most=PAGE_MOST + 1)


def normalized(hits: DataFrame) -> DataFrame:
    """Adds score_normalized (by the highest score), max_score and total_matches."""
    best = hits.agg(F.max("score").alias("top"), F.count("*").alias("n")).first()
    safe = best["top"] if best["top"] and best["top"] > 0 else 1.0
    return hits.withColumns({"max_score": F.lit(best["top"]), "total_matches": F.lit(best["n"]), "score_normalized": A.round4(F.col("score") / safe)})


def encode_cursor(score: float, id: str) -> str:
    if not id:
        raise ValueError("a cursor needs an id")
    return base64.urlsafe_b64encode(json.dumps({"s": score, "i": id}, separators=(",", ":")).encode()).decode()


def decode_cursor(text: str) -> tuple[float, str]:
    try:
        got = json.loads(base64.urlsafe_b64decode(text.encode()))
        score, id = float(got["s"]), str(got["i"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e
    if not id or set(id) <= {"0", "-"}:
        raise ValueError("invalid cursor")
    return score, id


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.desc("id")).limit(k)


def with_ranks(leg: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Ranks of the k best; the window sees just those rows."""
    from pyspark.sql import Window

    return leg.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _distances(query: list[float]):
    """Cosine distances of a batch of vectors of the query's length, as one product in double."""

    def find(batches):
        q = np.array(query, float)
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(q))
            norm = np.sqrt((x * x).sum(1) * (q * q).sum())
            cosine = np.where(norm > 0, (x @ q) / np.where(norm > 0, norm, 1), 0.0)
            names = [c for c in b.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.floor((1 - cosine) * 1e6 + 0.5) / 1e6)], [*names, "distance"])

    return find


def nearest(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """(id, distance) of the k smallest cosine distances to a query vector, exactly; smaller ids first among equals.

    Where vectors have a column ``version``, the highest one of an id counts; only distances are shuffled for that. Vectors with nulls take no part.
    """
    own = vectors.where((F.size("embedding") == len(query)) & ~F.exists("embedding", F.isnull))
    others = [f for f in own.schema.fields if f.name in ("id", "version")]
    out = own.select(*[f.name for f in others], "embedding").mapInArrow(_distances(query), T.StructType([*others, T.StructField("distance", T.DoubleType())]))
    if "version" in vectors.columns:
        out = out.groupBy("id").agg(F.max_by("distance", "version").alias("distance"))
    if threshold is not None:
        out = out.where(F.col("distance") < threshold)
    return out.orderBy("distance", "id").limit(k)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) legs: the sum of 1 / (k + rank)."""
    legs = lexical.select("id", (1 / (F.lit(float(k)) + F.col("rank"))).alias("a"), F.lit(0.0).alias("b")).unionByName(semantic.select("id", F.lit(0.0).alias("a"), (1 / (F.lit(float(k)) + F.col("rank"))).alias("b")))
    both = legs.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select("id", (F.floor((F.col("a") + F.col("b")) * 1e6 + 0.5) / 1e6).alias("score"))


def fuse_weighted(lexical: DataFrame, semantic: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weighted sum of the legs' own scores: (id, score) each."""
    legs = lexical.select("id", F.col("score").alias("a"), F.lit(0.0).alias("b")).unionByName(semantic.select("id", F.lit(0.0).alias("a"), F.col("score").alias("b")))
    both = legs.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select("id", A.round4(weight * F.col("a") + (1 - weight) * F.col("b")).alias("score"))
