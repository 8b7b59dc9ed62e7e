"""A stored search index: postings written once, sorted by term, so that a query reads only its own terms.

Three tables. Postings: a row per document, field and term, with how often and where it occurs and the field's length, so that BM25 and phrases
need nothing else. Vocabulary: a row per field and term with its stem, document and collection frequency; stems, prefixes and misspelt
terms are looked up here. Lengths: a row per document. Postings lie in files by range of (term, document), sorted by term: a condition on terms
is pushed to the scan and skips files and row groups, and a term with very many documents is several files. Texts are read when the index is built
and never again.

Places run through a document's fields in the order of ALL_FIELDS, each field behind the one before. Defined results: null fields are empty;
repeated rows of an id count once; ties go to the larger id; a query without words matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import stemming as S
from pressmill.functions import text as T
from pressmill.operators import boolean
from pressmill.operators import retrieval as R
from pressmill.session import materialize, release

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame  # term, id, field, tf, dl, places
    vocabulary: DataFrame  # term, stem, field, df, cf
    lengths: DataFrame  # id, dl_<field> of each
    documents: int
    average: dict[str, float]


def _posted(batches):
    """Fields of documents (id, field, toks, dl, start) to a row per term in each, with its places: a stable sort of the batch's tokens by row and term."""
    for b in batches:
        toks = b.column("toks")
        size = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), size)
        if not len(row):
            continue
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + b.column("start").to_numpy(zero_copy_only=False).astype(np.int64)[row]
        words = toks.flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        key = row * len(words.dictionary) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) > 0))
        ends = np.append(first, len(order))
        at = pa.array(row[order[first]])
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.take(pa.array(code[order[first]])), b.column("id").take(at), b.column("field").take(at), pa.array(np.diff(ends).astype(np.int32)), b.column("dl").take(at),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32))),
            ],
            ["term", "id", "field", "tf", "dl", "places"],
        )


def build(articles: DataFrame, fields: tuple[str, ...] = R.ALL_FIELDS, keep: bool = False) -> SearchIndex:
    """Writes the index of articles(id, fields) into the shared folder; keep: until the driver ends."""
    toks = R.analyzed(R.articles_once(articles.where("id IS NOT NULL").withColumn("id", F.col("id").cast("string")), fields), fields)
    sized = toks.select("id", *fields, *[F.size(f).alias(f"dl_{f}") for f in fields])
    starts = [sum((F.col(f"dl_{g}") for g in fields[:k]), F.lit(0)) for k in range(len(fields))]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("toks"), F.col(f"dl_{f}").alias("dl"), s.alias("start")) for f, s in zip(fields, starts)])
    posted = sized.select("id", F.inline(each)).where("dl > 0").mapInArrow(_posted, "term string, id string, field string, tf int, dl int, places array<int>")
    posted = materialize(posted, "unsorted")  # a range sort evaluates its input twice
    postings = materialize(posted.repartitionByRange("term", "id", "field").sortWithinPartitions("term", "id", "field"), "postings", keep)
    release(posted)
    lengths = materialize(sized.select("id", *[f"dl_{f}" for f in fields]), "lengths", keep)
    counts = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms = counts.groupBy("term").agg(F.collect_list(F.struct("field", "df", "cf")).alias("f")).select("term", S.stems(F.col("term")).alias("stem"), F.inline("f"))
    vocabulary = materialize(terms.repartitionByRange("term").sortWithinPartitions("term"), "vocabulary", keep)
    one = lengths.agg(F.count("*").alias("n"), *[F.avg(f"dl_{f}").alias(f) for f in fields]).first()
    return SearchIndex(postings, vocabulary, lengths, one["n"], {f: one[f] or 0.0 for f in fields})


_open: dict[tuple, SearchIndex] = {}


def of_table(spark: SparkSession, path: str) -> SearchIndex:
    """The index of the article table at path, built when it is first asked for, and again when its files have changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    key = (spark.sparkContext.applicationId, path, tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)))
    if key not in _open:
        _open[key] = build(spark.read.parquet(path), keep=True)
    return _open[key]


def _expanded(index: SearchIndex, terms: list[str], fields: tuple[str, ...], fuzziness: int) -> DataFrame:
    """Postings of each query term with its number ``i``; a term allowed edits stands for all words of the vocabulary within them."""
    p = index.postings.where(F.col("field").isin(*fields))
    exact = [t for t in terms if not R.edits(t, fuzziness)]
    number = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")).cast("int") - 1
    out = p.where(F.col("term").isin(*exact)).withColumn("i", number) if exact else None
    for i, t in enumerate(terms):
        if R.edits(t, fuzziness):
            near = index.vocabulary.select("term").where(F.levenshtein("term", F.lit(t), R.edits(t, fuzziness)) >= 0).distinct()
            rows = p.join(near, "term", "left_semi").withColumn("i", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
    return out


def _frequencies(index: SearchIndex, counted: DataFrame, terms: list[str], q: R.Match) -> dict[tuple[str, int], int]:
    """Documents that have each term in each field: from the vocabulary, or counted where a term stands for several words."""
    if not any(R.edits(t, q.fuzziness) for t in terms):
        rows = index.vocabulary.where(F.col("term").isin(*terms) & F.col("field").isin(*q.fields)).select("field", "term", "df").collect()
        return {(r["field"], terms.index(r["term"])): r["df"] for r in rows}
    one = counted.agg(*[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"{f} {i}") for f in q.fields for i in range(len(terms))]).first()
    return {(f, i): one[f"{f} {i}"] for f in q.fields for i in range(len(terms))}


def _counted(index: SearchIndex, q: R.Match, terms: list[str]) -> DataFrame:
    """(id, dl_<field>, tf_<field>_<i>) of the documents with any term."""
    at = lambda f, i: (F.col("field") == f) & (F.col("i") == i)
    return _expanded(index, terms, q.fields, q.fuzziness).groupBy("id").agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("dl"))), F.lit(0)).alias(f"dl_{f}") for f in q.fields],
        *[F.coalesce(F.sum(F.when(at(f, i), F.col("tf"))), F.lit(0)).alias(f"tf_{f}_{i}") for f in q.fields for i in range(len(terms))],
    )


def scored(index: SearchIndex, q: R.Match) -> DataFrame:
    """(id, score, matched) of the documents with any of the terms."""
    terms = R.words_of(q.text)
    if not terms:
        return index.lengths.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(False).alias("matched"))
    counted = _counted(index, q, terms)
    df = _frequencies(index, counted, terms, q)
    return R.scores(counted, q, len(terms), index.documents, {(f, i): df.get((f, i), 0) for f in q.fields for i in range(len(terms))}, index.average)


def search(index: SearchIndex, q: R.Match) -> DataFrame:
    """(id, score) of the matching documents."""
    return scored(index, q).where("matched").select("id", "score")


def rank_all(index: SearchIndex, q: R.Match, k: int) -> DataFrame:
    """(id, score): the k best of all documents by BM25 of their fields put together, those without a hit with score 0."""
    terms = R.words_of(q.text)
    p = index.postings.where(F.col("term").isin(*terms) & F.col("field").isin(*q.fields))
    per = p.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(terms)])
    df = per.agg(*[F.count(f"tf_{i}").alias(f"{i}") for i in range(len(terms))]).first()
    length, average = sum((F.col(f"dl_{f}") for f in q.fields), F.lit(0)), sum(index.average[f] for f in q.fields)
    tf = lambda i: F.coalesce(F.col(f"tf_{i}"), F.lit(0))
    score = sum((R.bm25(tf(i), length, df[i], index.documents, average) for i in range(len(terms))), F.lit(0.0))
    return R.top(index.lengths.join(per, "id", "left").select("id", T.round4(score).alias("score")), k)


def _phrase_counts(index: SearchIndex, words: list[str], fields: tuple[str, ...], slop: int) -> DataFrame:
    """(id, field, dl, times): how often the words follow one another; with slop, whether they do at some equal distance each."""
    terms = list(dict.fromkeys(words))
    at = index.postings.where(F.col("term").isin(*terms) & F.col("field").isin(*fields)).groupBy("id", "field").agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    at = at.where(F.size("at") == len(terms))
    place = lambda w: F.col("at")[w]
    if len(words) == 1:
        times = F.size(place(words[0]))
    elif slop == 0:
        follows = lambda p: _all(F.array_contains(place(w), p + k) for k, w in enumerate(words) if k)
        times = F.size(F.filter(place(words[0]), follows))
    else:
        apart = lambda a, b, d: F.arrays_overlap(F.transform(place(a), lambda p: p + d), place(b))
        times = sum((_all(apart(a, b, d + 1) for a, b in zip(words, words[1:])).cast("int") for d in range(slop + 1)), F.lit(0))
    return at.select("id", "field", "dl", times.alias("times")).where("times > 0")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def match_phrase(index: SearchIndex, q: R.Phrase) -> DataFrame:
    """(id, score, fields): BM25 of the phrase, summed over the fields, and in how many it occurs. A phrase weighs what its words do together."""
    words = R.phrase_words(q)
    if not words:
        return index.lengths.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("fields"))
    known = index.vocabulary.where(F.col("term").isin(*set(words)) & F.col("field").isin(*q.fields)).select("term", "field", "df").collect()
    df = {(r["field"], r["term"]): r["df"] for r in known}
    score = F.lit(0.0)
    for f in q.fields:
        part = sum((R.bm25(F.col("times"), F.col("dl"), df.get((f, w), 0), index.documents, index.average[f]) for w in words), F.lit(0.0))
        score = score + F.when(F.col("field") == f, part).otherwise(0.0)
    return _phrase_counts(index, words, q.fields, q.slop).groupBy("id").agg(T.round4(F.sum(score)).alias("score"), F.count("*").cast("int").alias("fields"))


def _leaves(n: boolean.Node) -> list[tuple[str, ...]]:
    return [n.words] if n.kind == "words" else [w for c in n.children for w in _leaves(c)]


def _holds(n: boolean.Node, leaf) -> Column:
    if n.kind == "words":
        return leaf(n.words)
    if n.kind == "not":
        return ~_holds(n.children[0], leaf)
    out = _holds(n.children[0], leaf)
    for c in n.children[1:]:
        out = (out & _holds(c, leaf)) if n.kind == "and" else (out | _holds(c, leaf))
    return out


def _empty_matches(n: boolean.Node) -> bool:
    """Whether a document without any of the words satisfies the expression."""
    kids = [_empty_matches(c) for c in n.children]
    return {"words": False, "not": not (kids or [True])[0], "and": all(kids), "or": any(kids)}[n.kind]


def match_boolean(index: SearchIndex, q: R.Boolean) -> DataFrame:
    """(id, score) of the documents whose fields together satisfy the expression; the score is BM25 of the words that aren't negated, in any of the fields."""
    tree = boolean.parse(q.expression)
    leaves = list(dict.fromkeys(_leaves(tree)))
    hits = None
    for k, words in enumerate(leaves):
        own = index.postings.where((F.col("term") == words[0]) & F.col("field").isin(*q.fields)).select("id") if len(words) == 1 else _phrase_counts(index, list(words), q.fields, 0).select("id")
        own = own.select("id", F.lit(k).alias("leaf"))
        hits = own if hits is None else hits.unionByName(own)
    per = hits.groupBy("id").agg(*[F.max(F.col("leaf") == k).alias(f"b{k}") for k in range(len(leaves))])
    if _empty_matches(tree):
        per = index.lengths.select("id").join(per, "id", "left")
    found = per.where(_holds(tree, lambda w: F.coalesce(F.col(f"b{leaves.index(w)}"), F.lit(False)))).select("id")
    words = boolean.terms(tree)
    if not words:
        return found.withColumn("score", F.lit(0.0))
    ranked = scored(index, R.Match(" ".join(words), q.fields)).select("id", "score")
    return found.join(ranked, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def near(index: SearchIndex, first: str, second: str, distance: int, field: str, ordered: bool = False) -> DataFrame:
    """(id): where two words of a field stand at most ``distance`` places apart, in any order or in this one."""
    at = index.postings.where(F.col("term").isin(first, second) & (F.col("field") == field)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).where("size(at) = 2")
    gap = lambda p, x: (x - p).between(1 if ordered else -distance, distance)
    return at.where(F.exists(F.col("at")[first], lambda p: F.exists(F.col("at")[second], lambda x: gap(p, x)))).select("id")


def prefix(index: SearchIndex, start: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, hits): how many words begin like this; the sorted terms make it a range."""
    end = start[:-1] + chr(ord(start[-1]) + 1)
    return index.postings.where((F.col("term") >= start) & (F.col("term") < end) & F.col("field").isin(*fields)).groupBy("id").agg(F.sum("tf").cast("int").alias("hits"))


def term_set(index: SearchIndex, terms: list[str], fields: tuple[str, ...], score: float = 1.0) -> DataFrame:
    """(id, score): documents with any of the terms, all with the same score."""
    return index.postings.where(F.col("term").isin(*terms) & F.col("field").isin(*fields)).select("id").distinct().withColumn("score", F.lit(float(score)))


def _lexeme_places(index: SearchIndex, text: str, fields: tuple[str, ...], weights: dict[str, float]) -> tuple[list[tuple[str, int]], DataFrame | None]:
    """The query's lexemes, and (id, at): for each lexeme its places with the weights of their fields' labels, in order, of the documents with any."""
    wanted = S.lexemes([w for _, v in boolean.lex(text) for w in v.lower().split()])
    stems = list(dict.fromkeys(s for s, _ in wanted))
    if not stems:
        return [], None
    words = index.vocabulary.where(F.col("stem").isin(*stems) & S.indexed(F.col("term"))).select("term", "stem").distinct()
    label = F.create_map(*[F.lit(x) for f in fields for x in (f, float(weights[R.LABELS[f]]))])
    p = index.postings.where(F.col("field").isin(*fields)).join(words, "term").select("id", "stem", F.explode("places").alias("place"), label[F.col("field")].alias("w"))
    per = p.groupBy("id", "stem").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("p"))
    return wanted, per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "p"))).alias("at"))


def _has_place(places: Column, place: Column) -> Column:
    return F.exists(places, lambda y: y["place"] == place)


def _apart(a: Column, b: Column) -> Column:
    """The product over all pairs of places of two lexemes of one less what the pair is worth."""

    def pair(x, y):
        d = F.abs(x["place"] - y["place"])
        near = F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        return 1 - F.sqrt(x["w"] * y["w"] * near)

    product = lambda xs: F.aggregate(xs, F.lit(1.0), lambda r, v: r * v)
    return product(F.transform(a, lambda x: product(F.transform(b, lambda y: pair(x, y)))))


def ts_rank(index: SearchIndex, text: str, operator: str = "or", fields: tuple[str, ...] = R.ALL_FIELDS, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score): stemmed words without stop words in labelled fields, ranked as PostgreSQL's ts_rank does; operator "or", "and" or "phrase".

    Single words and "or": per lexeme the best weight and the others by the square of their order, averaged. "and" and "phrase": pairs of places of
    different lexemes, nearer ones for more. A phrase needs its lexemes at the query's own distances.
    """
    wanted, found = _lexeme_places(index, text, fields, weights or WEIGHTS)
    if found is None:
        return index.lengths.limit(0).select("id", F.lit(0.0).alias("score"))
    stems = list(dict.fromkeys(s for s, _ in wanted))
    at = lambda s: F.col("at")[s]
    if operator == "or" or len(stems) == 1:
        total = F.lit(0.0)
        for s in stems:
            w = F.transform(at(s), lambda x: x["w"])
            best, first = F.array_max(w), F.array_position(w, F.array_max(w))
            series = F.aggregate(F.transform(w, lambda x, j: x / F.pow(j + 1, F.lit(2))), F.lit(0.0), lambda a, x: a + x)
            total = total + F.when(at(s).isNotNull(), (best + series - best / F.pow(first, F.lit(2))) / 1.64493406685).otherwise(0.0)
        score = total / len(stems)
    else:
        left = F.lit(1.0)
        for i, a in enumerate(stems):
            for b in stems[:i]:
                left = left * _apart(at(a), at(b))
        score = 1 - left
    if operator != "or":
        found = found.where(F.size("at") == len(stems))
    if operator == "phrase" and len(wanted) > 1:
        start, origin = wanted[0]
        found = found.where(F.exists(at(start), lambda p: _all(_has_place(at(s), p["place"] + (k - origin)) for s, k in wanted[1:])))
    return found.select("id", T.round4(score).alias("score"))
