"""Queries over runs, grades and latency samples, and the ETL of vectors and files, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.operators import embeddings as E
from pressmill.operators import evaluation as V
from pressmill.operators import judge_runs as JR
from pressmill.operators import judging as J
from pressmill.plans.search_queries import DIM, MODEL, VECTORS, versions
from pressmill.session import table
from pressmill.sources import files

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _r6(c):
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def _round(columns: list[str]) -> str:
    return ", ".join(f"floor({c} * 1e6 + 0.5e0) / 1e6 AS {c}" for c in columns)


METRICS = [f"{m}_{k}" for k in V.KS for m in ("ndcg", "p", "r", "f1")] + ["ap", "rr", "bpref"]
_G = "g AS (SELECT query_id, doc_id, max(grade) AS grade FROM qrels WHERE grade >= 0 GROUP BY ALL)"
_X = "x AS (SELECT job, query_id, engine, max(category) AS category, bool_or(error IS NOT NULL) AS failed FROM runs GROUP BY job, query_id, engine)"


def _per_query() -> str:
    ks = V.KS
    gain = "(pow(2e0, grade) - 1) / log2(n + 1)"
    ideal = ", ".join(f"sum(CASE WHEN n <= {k} THEN {gain} END) AS ideal_{k}" for k in ks)
    dcg = ", ".join(f"coalesce(sum(CASE WHEN rel AND rank <= {k} THEN (pow(2e0, grade) - 1) / log2(rank + 1) END), 0) AS dcg_{k}, count(*) FILTER (WHERE rel AND rank <= {k}) AS found_{k}" for k in ks)
    out = []
    for k in ks:
        p, r = f"(coalesce(found_{k}, 0) / {k}e0)", f"(CASE WHEN relevant > 0 THEN coalesce(found_{k}, 0) / relevant::DOUBLE ELSE 0 END)"
        out += [f"CASE WHEN ideal_{k} > 0 THEN coalesce(dcg_{k}, 0) / ideal_{k} ELSE 0 END AS ndcg_{k}", f"{p} AS p_{k}", f"{r} AS r_{k}", f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END AS f1_{k}"]
    return f"""{_G}, {_X},
o AS (SELECT query_id, count(*) AS relevant, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS n FROM g WHERE grade >= 1) GROUP BY query_id),
k AS (SELECT r.job, r.query_id, r.engine, r.rank, grade, coalesce(grade >= 1, false) AS rel, coalesce(relevant, 0) AS relevant FROM runs r LEFT JOIN g USING (query_id, doc_id) LEFT JOIN o USING (query_id) WHERE rank IS NOT NULL AND doc_id IS NOT NULL),
h AS (SELECT *, sum(rel::INT) OVER w AS hits, sum((grade IS NOT NULL AND NOT rel)::INT) OVER w AS misses FROM k WINDOW w AS (PARTITION BY job, query_id, engine ORDER BY rank ROWS UNBOUNDED PRECEDING)),
u AS (SELECT job, query_id, engine, {dcg}, coalesce(sum(CASE WHEN rel THEN hits / rank::DOUBLE END), 0) AS precisions, min(CASE WHEN rel THEN rank END) AS first, coalesce(sum(CASE WHEN rel THEN 1 - least(misses, relevant) / relevant::DOUBLE END), 0) AS preferences FROM h GROUP BY job, query_id, engine),
m AS (SELECT job, query_id, engine, category, query_id IN (SELECT query_id FROM g) AS judged, {', '.join(out)},
CASE WHEN relevant > 0 THEN coalesce(precisions, 0) / relevant ELSE 0 END AS ap, coalesce(1e0 / first, 0) AS rr, CASE WHEN relevant > 0 THEN coalesce(preferences, 0) / relevant ELSE 0 END AS bpref
FROM x LEFT JOIN u USING (job, query_id, engine) LEFT JOIN o USING (query_id) WHERE NOT failed)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return V.per_query(table(spark, d, "runs"), V.grades(table(spark, d, "qrels")))


def _some(spark, d, names):
    return _metrics(spark, d).select("job", "query_id", "engine", "judged", *[_r6(c).alias(c) for c in names])


def _some_sql(names):
    return f"WITH {_per_query()} SELECT job, query_id, engine, judged, {_round(names)} FROM m"


@_query(_some_sql([f"ndcg_{k}" for k in V.KS]))
def ndcg_at_k(spark, d):
    return _some(spark, d, [f"ndcg_{k}" for k in V.KS])


_PRF = [f"{m}_{k}" for k in V.KS for m in ("p", "r", "f1")]


@_query(_some_sql(_PRF))
def precision_recall_f1(spark, d):
    return _some(spark, d, _PRF)


@_query(_some_sql(["ap"]))
def average_precision(spark, d):
    return _some(spark, d, ["ap"])


@_query(_some_sql(["rr"]))
def reciprocal_rank(spark, d):
    return _some(spark, d, ["rr"])


@_query(_some_sql(["bpref"]))
def bpref(spark, d):
    return _some(spark, d, ["bpref"])


def _aggregate_sql(by: str, where: str = "") -> str:
    means = ", ".join(f"floor(avg({c}) * 1e6 + 0.5e0) / 1e6 AS mean_{c}" for c in METRICS) + ", " + ", ".join(f"floor(stddev_samp(ndcg_{k}) * 1e6 + 0.5e0) / 1e6 AS sd_ndcg_{k}" for k in V.KS)
    return f"WITH {_per_query()}, c AS (SELECT {by}, count(*) AS queries, count(*) FILTER (WHERE failed) AS errors FROM x GROUP BY ALL), a AS (SELECT {by}, count(*) AS judged, {means} FROM m WHERE judged GROUP BY {by}) SELECT c.*, coalesce(a.judged, 0) AS judged, a.* EXCLUDE ({by}, judged) FROM c LEFT JOIN a USING ({by}) {where}"


def _rounded_means(df: DataFrame) -> DataFrame:
    return df.select(*[_r6(c).alias(c) if c.startswith(("mean_", "sd_")) else c for c in df.columns])


@_query(_aggregate_sql("job, engine"))
def engine_aggregate(spark, d):
    return _rounded_means(V.aggregate(table(spark, d, "runs"), _metrics(spark, d)))


@_query(_aggregate_sql("job, category, engine", "WHERE job IN (SELECT job FROM x GROUP BY job HAVING count(DISTINCT category) > 1)"))
def category_aggregate(spark, d):
    return _rounded_means(V.by_category(table(spark, d, "runs"), _metrics(spark, d)))


_POOL = "f AS (SELECT query_id, engine, min(job) AS job FROM runs WHERE error IS NULL AND doc_id IS NOT NULL GROUP BY ALL), pool AS (SELECT query_id, doc_id, list_sort(list(DISTINCT engine)) AS sources FROM runs JOIN f USING (query_id, engine, job) WHERE error IS NULL AND doc_id IS NOT NULL AND rank <= 50 GROUP BY ALL)"


@_query(f"WITH {_POOL} SELECT query_id, doc_id, array_to_string(sources, ',') AS sources FROM pool")
def pool_union(spark, d):
    return V.pool(table(spark, d, "runs")).select("query_id", "doc_id", F.array_join("sources", ",").alias("sources"))


@_query(f"WITH {_POOL} SELECT query_id, count(*) AS docs, sum(len(sources))::BIGINT AS hits, floor((1 - count(*) / sum(len(sources))::DOUBLE) * 1e4 + 0.5e0) / 1e4 AS dedup FROM pool GROUP BY query_id")
def pool_summary(spark, d):
    return V.pool_summary(V.pool(table(spark, d, "runs")))


@_query(f"WITH {_POOL} SELECT unnest(sources) AS engine, count(*) AS docs FROM pool GROUP BY 1")
def pool_contribution(spark, d):
    return V.pool(table(spark, d, "runs")).select(F.explode("sources").alias("engine")).groupBy("engine").agg(F.count("*").alias("docs"))


@_query("SELECT judge, query_id, " + ", ".join(f"count(*) FILTER (WHERE grade = {k}) AS {'unjudged' if k < 0 else f'grade_{k}'}" for k in (-1, 0, 1, 2, 3)) + ", count(*) FILTER (WHERE grade >= 0) AS graded FROM (SELECT DISTINCT * FROM qrels) GROUP BY judge, query_id")
def grade_histogram(spark, d):
    return V.grade_histogram(table(spark, d, "qrels"))


@_query("SELECT DISTINCT query_id || ' 0 ' || doc_id || ' ' || grade AS line FROM qrels WHERE grade >= 0")
def qrels_export(spark, d):
    return files.qrels_lines(table(spark, d, "qrels")).distinct()


@_query("SELECT DISTINCT query_id, doc_id, grade, false AS bad FROM qrels WHERE grade >= 0")
def qrels_round_trip(spark, d):
    return files.parse_qrels(files.qrels_lines(table(spark, d, "qrels")).withColumnRenamed("line", "value")).distinct()


_PS = (50, 75, 90, 95, 99)


@_query("SELECT event_type, count(*) AS n, min(ns) AS min, max(ns) AS max, floor(avg(ns))::BIGINT AS mean, floor(stddev_samp(ns))::BIGINT AS sd, " + ", ".join(f"floor(quantile_cont(ns, {p / 100}))::BIGINT AS p{p}" for p in _PS) + " FROM (SELECT event_type, floor(value * 1000)::BIGINT AS ns FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def latency_stats(spark, d):
    return V.latency(table(spark, d, "events").where("value IS NOT NULL").withColumn("ns", F.floor(F.col("value") * 1000)), "event_type", "ns")


_DIFFS = " UNION ALL ".join(f"SELECT job, query_id, engine, '{n}' AS metric, {n} AS value FROM m WHERE judged" for n in ("ndcg_5", "ndcg_10", "ap", "rr"))


@_query(f"""WITH {_per_query()}, l AS ({_DIFFS}),
d AS (SELECT a.job, a.engine AS engine_a, b.engine AS engine_b, metric, floor((a.value - b.value) * 1e9 + 0.5e0) / 1e9 AS d FROM l a JOIN l b USING (job, query_id, metric) WHERE a.engine < b.engine),
t AS (SELECT *, count(*) OVER (PARTITION BY job, engine_a, engine_b, metric, abs(d)) AS t, rank() OVER (PARTITION BY job, engine_a, engine_b, metric ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
s AS (SELECT job, engine_a, engine_b, metric, count(*) AS n, sum(CASE WHEN d > 0 THEN r + (t - 1) / 2e0 ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN r + (t - 1) / 2e0 ELSE 0 END) AS down, sum((t * t - 1) / 48e0) AS ties FROM t GROUP BY ALL HAVING count(*) >= 4),
v AS (SELECT *, least(up, down) AS w, n * (n + 1) * (2 * n + 1) / 24e0 - ties AS variance FROM s)
SELECT job, engine_a, engine_b, metric, n, w, floor((CASE WHEN variance > 0 THEN (w - n * (n + 1) / 4e0 + 0.5e0) / sqrt(variance) ELSE 0 END) * 1e6 + 0.5e0) / 1e6 AS z FROM v""")
def wilcoxon_w(spark, d):
    return V.wilcoxon(_metrics(spark, d))


@_query(f"WITH {_per_query()}, j AS (SELECT min(job) AS a, max(job) AS b FROM runs), p AS (SELECT * FROM m, j WHERE job = a), q AS (SELECT * FROM m, j WHERE job = b) SELECT query_id, engine, floor(p.ndcg_10 * 1e6 + 0.5e0) / 1e6 AS before, floor(q.ndcg_10 * 1e6 + 0.5e0) / 1e6 AS after, floor((q.ndcg_10 - p.ndcg_10) * 1e6 + 0.5e0) / 1e6 AS delta FROM p FULL JOIN q USING (query_id, engine)")
def run_diff(spark, d):
    """The first job against the last."""
    r = table(spark, d, "runs").agg(F.min("job").alias("a"), F.max("job").alias("b")).first()
    out = V.difference(_metrics(spark, d), r["a"], r["b"])
    return out.select("query_id", "engine", _r6("before").alias("before"), _r6("after").alias("after"), "delta")


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    """The pool with the texts, and as a query's text and vector: the text of its first item and the vector of its first document."""
    pooled = V.pool(table(spark, d, "runs")).select("query_id", "doc_id")
    texts = table(spark, d, "bench_items").groupBy("query_id").agg(F.min_by("text", "item_id").alias("query_text"))
    wanted = pooled.select(F.col("doc_id").alias("id"))
    docs = E.by_ids(table(spark, d, "articles"), wanted).groupBy(F.col("id").alias("doc_id")).agg(*[F.max(c).alias(c) for c in ("title", "description", "content")])
    own = E.by_ids(versions(spark, d), wanted)
    v = own.groupBy(F.col("id").alias("doc_id")).agg(F.max_by("embedding", "version").alias("embedding"))
    first = pooled.join(v, "doc_id").groupBy("query_id").agg(F.min_by("embedding", "doc_id").alias("query_vector"))
    return pooled.join(docs, "doc_id").join(texts, "query_id").join(v, "doc_id", "left").join(first, "query_id", "left")


_STOP = "['a','an','and','the','or','of','to','in','on','at','by','for','with','from','is','are','was','were','be','been','being','it','its','as','that','this','these','those','news','article','search','query']"


def _judge_toks(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 3)"


_POOLED = f"""{_POOL}, {VECTORS.replace('q AS (', 'unused AS (')},
a AS (SELECT id AS doc_id, max(title) AS title, max(description) AS description, max(content) AS content FROM articles GROUP BY id),
b AS (SELECT query_id, arg_min(text, item_id) AS query_text FROM bench_items GROUP BY query_id),
qv AS (SELECT query_id, arg_min(e, doc_id) AS w FROM pool JOIN v ON id = doc_id GROUP BY query_id),
pd AS (SELECT p.query_id, p.doc_id, title, description, content, list_sort(list_filter(list_distinct({_judge_toks('query_text')}), lambda x: NOT list_contains({_STOP}, x))) AS q, e, w FROM pool p JOIN a USING (doc_id) JOIN b USING (query_id) LEFT JOIN v ON v.id = p.doc_id LEFT JOIN qv USING (query_id))"""
_LEXICAL = f"""WITH {_POOLED}, k AS (SELECT query_id, doc_id, q, list_distinct({_judge_toks("coalesce(title, '')")}) AS t, list_distinct({_judge_toks("concat_ws(' ', description, content)")}) AS o FROM pd WHERE len(q) > 0),
n AS (SELECT query_id, doc_id, len(q)::DOUBLE AS n, len(list_filter(q, lambda x: list_contains(t, x))) AS th, len(list_filter(q, lambda x: list_contains(t, x) OR list_contains(o, x))) AS ah FROM k)
SELECT query_id, doc_id, CASE WHEN th / n >= 0.5e0 THEN 3 WHEN ah / n >= 0.5e0 THEN 2 WHEN ah / n >= 0.25e0 THEN 1 ELSE 0 END AS grade FROM n"""
_BM25 = f"""{_POOLED}, k AS (SELECT query_id, doc_id, q, {_judge_toks("concat_ws(' ', title, description, content)")} AS toks FROM pd),
per AS (SELECT query_id, count(*) AS n, avg(len(toks)) AS avgdl FROM k GROUP BY query_id),
tf AS (SELECT query_id, doc_id, dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM (SELECT query_id, doc_id, len(toks) AS dl, toks, unnest(q) AS term FROM k)),
df AS (SELECT query_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) ORDER BY term) AS score FROM tf JOIN df USING (query_id, term) JOIN per USING (query_id) WHERE tf > 0 GROUP BY ALL),
nm AS (SELECT k.query_id, k.doc_id, coalesce(score, 0) / CASE WHEN max(score) OVER (PARTITION BY k.query_id) > 0 THEN max(score) OVER (PARTITION BY k.query_id) ELSE 1 END AS norm FROM k LEFT JOIN sc USING (query_id, doc_id))"""


def _steps(x: str, a: float, b: float, c: float) -> str:
    x = f"floor(({x}) * 1e6 + 0.5e0) / 1e6"
    return f"CASE WHEN {x} >= {a}e0 THEN 3 WHEN {x} >= {b}e0 THEN 2 WHEN {x} >= {c}e0 THEN 1 ELSE 0 END"


@_query(_LEXICAL)
def judge_lexical(spark, d):
    return J.lexical(_pooled(spark, d))


@_query(f"WITH {_BM25} SELECT query_id, doc_id, {_steps('norm', 0.66, 0.4, 0.15)} AS grade FROM nm")
def judge_bm25(spark, d):
    return J.bm25(_pooled(spark, d))


@_query(f"WITH {_POOLED} SELECT query_id, doc_id, {_steps('list_cosine_similarity(e, w)', 0.7, 0.55, 0.4)} AS grade FROM pd WHERE e IS NOT NULL AND w IS NOT NULL")
def judge_vector(spark, d):
    return J.vector(_pooled(spark, d))


@_query(f"WITH {_BM25} SELECT query_id, doc_id, {_steps('0.5e0 * norm + 0.5e0 * greatest(list_cosine_similarity(e, w), 0)', 0.66, 0.4, 0.15)} AS grade FROM nm JOIN pd USING (query_id, doc_id) WHERE e IS NOT NULL AND w IS NOT NULL")
def judge_hybrid(spark, d):
    return J.hybrid(_pooled(spark, d))


@_query(f"WITH {_POOL} SELECT query_id, doc_id, -1 AS grade FROM pool")
def judge_manual(spark, d):
    return J.manual(V.pool(table(spark, d, "runs")))


@_query(f"WITH {_POOL} SELECT query_id, doc_id FROM pool p WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = p.query_id AND q.doc_id = p.doc_id)")
def judge_resume(spark, d):
    """What is still to be graded when judging goes on."""
    return J.remaining(V.pool(table(spark, d, "runs")).select("query_id", "doc_id"), table(spark, d, "qrels"))


# Runs in which documents, grades and engines overlap: each engine ranks the documents that were ever graded for a query by a hash of its own,
# two of them by grade first for every other query, so that the metrics differ from zero and between engines.
_DERIVED = """runs AS (SELECT job, query_id, category, engine, rank::INT AS rank, doc_id, 1e0 / rank AS score, NULL::VARCHAR AS error FROM (
SELECT *, row_number() OVER (PARTITION BY job, query_id, engine ORDER BY CASE WHEN by_grade AND substr(md5(job || query_id), 1, 1) < '8' THEN -best ELSE 0 END, md5(job || engine || doc_id)) AS rank
FROM (SELECT query_id, doc_id, max(grade) AS best, 'kind ' || substr(md5(query_id), 1, 1) AS category FROM qrels GROUP BY query_id, doc_id), (VALUES ('first'), ('second')) AS j(job),
(VALUES ('alpha', true), ('beta', true), ('gamma', false), ('delta', false)) AS e(engine, by_grade)) WHERE rank <= 10)"""


def _derived(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").groupBy("query_id", "doc_id").agg(F.max("grade").alias("best"))
    q = q.withColumn("category", F.concat(F.lit("kind "), F.substring(F.md5("query_id"), 1, 1)))
    named = F.array(*[F.struct(F.lit(n).alias("engine"), F.lit(b).alias("by_grade")) for n, b in (("alpha", True), ("beta", True), ("gamma", False), ("delta", False))])
    q = q.withColumn("job", F.explode(F.array(F.lit("first"), F.lit("second")))).withColumn("e", F.explode(named)).select("*", "e.*")
    first = F.when(F.col("by_grade") & (F.substring(F.md5(F.concat("job", "query_id")), 1, 1) < "8"), -F.col("best")).otherwise(0)
    w = Window.partitionBy("job", "query_id", "engine").orderBy(first, F.md5(F.concat("job", "engine", "doc_id")))
    ranked = q.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return ranked.select("job", "query_id", "category", "engine", "rank", "doc_id", (1 / F.col("rank")).alias("score"), F.lit(None).cast("string").alias("error"))


def _derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return V.per_query(_derived(spark, d), V.grades(table(spark, d, "qrels")))


@_query(f"WITH {_DERIVED}, {_per_query()} SELECT job, query_id, engine, judged, {_round(METRICS)} FROM m")
def metrics_of_overlapping_runs(spark, d):
    """All metrics of runs that overlap with the grades."""
    return _derived_metrics(spark, d).select("job", "query_id", "engine", "judged", *[_r6(c).alias(c) for c in METRICS])


@_query(_aggregate_sql("job, engine").replace("WITH ", f"WITH {_DERIVED}, ", 1))
def engine_aggregate_overlapping(spark, d):
    return _rounded_means(V.aggregate(_derived(spark, d), _derived_metrics(spark, d)))


@_query(_aggregate_sql("job, category, engine", "WHERE job IN (SELECT job FROM x GROUP BY job HAVING count(DISTINCT category) > 1)").replace("WITH ", f"WITH {_DERIVED}, ", 1))
def category_aggregate_overlapping(spark, d):
    return _rounded_means(V.by_category(_derived(spark, d), _derived_metrics(spark, d)))


_TESTED = (*(f"ndcg_{k}" for k in V.KS), "ap", "rr")
_Z = "sum(CASE WHEN {0} THEN r + (t - 1) / 2e0 ELSE 0 END)"


@_query(f"""WITH {_DERIVED}, {_per_query()}, l AS ({" UNION ALL ".join(f"SELECT job, query_id, engine, '{n}' AS metric, {n} AS value FROM m WHERE judged" for n in _TESTED)}),
d AS (SELECT a.job, a.engine AS engine_a, b.engine AS engine_b, metric, floor((a.value - b.value) * 1e9 + 0.5e0) / 1e9 AS d FROM l a JOIN l b USING (job, query_id, metric) WHERE a.engine < b.engine),
t AS (SELECT *, count(*) OVER (PARTITION BY job, engine_a, engine_b, metric, abs(d)) AS t, rank() OVER (PARTITION BY job, engine_a, engine_b, metric ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
s AS (SELECT job, engine_a, engine_b, metric, count(*) AS n, {_Z.format("d > 0")} AS up, {_Z.format("d < 0")} AS down, sum((t * t - 1) / 48e0) AS ties FROM t GROUP BY ALL HAVING count(*) >= 4),
v AS (SELECT *, least(up, down) AS w, n * (n + 1) * (2 * n + 1) / 24e0 - ties AS variance FROM s),
z AS (SELECT *, floor((CASE WHEN variance > 0 THEN (w - n * (n + 1) / 4e0 + 0.5e0) / sqrt(variance) ELSE 0 END) * 1e6 + 0.5e0) / 1e6 AS z FROM v)
SELECT job, engine_a, engine_b, metric, n, w, z, CASE WHEN abs(z) > 2.5758293e0 THEN '**' WHEN abs(z) > 1.9599640e0 THEN '*' ELSE '' END AS stars FROM z""")
def significance_matrix(spark, d):
    """All pairs of engines on all metrics; the stars are those of p < 0.01 and p < 0.05."""
    return V.significance(_derived_metrics(spark, d)).drop("p")


@_query(f"WITH {_DERIVED}, {_per_query()}, p AS (SELECT * FROM m WHERE job = 'first'), q AS (SELECT * FROM m WHERE job = 'second') SELECT query_id, engine, floor(p.ndcg_10 * 1e6 + 0.5e0) / 1e6 AS before, floor(q.ndcg_10 * 1e6 + 0.5e0) / 1e6 AS after, floor((q.ndcg_10 - p.ndcg_10) * 1e6 + 0.5e0) / 1e6 AS delta FROM p JOIN q USING (query_id, engine)")
def run_regressions(spark, d):
    out = V.regressions(_derived_metrics(spark, d), "first", "second")
    return out.select("query_id", "engine", _r6("before").alias("before"), _r6("after").alias("after"), "delta")


@_query(f"""WITH {_DERIVED}, {_per_query()}, l AS ({" UNION ALL ".join(f"SELECT job, engine, '{n}' AS metric, avg({n}) AS v FROM m WHERE judged GROUP BY ALL" for n in METRICS)})
SELECT engine, metric, floor(a.v * 1e6 + 0.5e0) / 1e6 AS before, floor(b.v * 1e6 + 0.5e0) / 1e6 AS after, floor((b.v - a.v) * 1e6 + 0.5e0) / 1e6 AS delta FROM (SELECT * FROM l WHERE job = 'first') a FULL JOIN (SELECT * FROM l WHERE job = 'second') b USING (engine, metric)""")
def aggregate_diff(spark, d):
    out = V.aggregate_difference(V.aggregate(_derived(spark, d), _derived_metrics(spark, d)), "first", "second")
    return out.select("engine", "metric", _r6("before").alias("before"), _r6("after").alias("after"), "delta")


@_query(f"WITH {_DERIVED}, {_per_query()}, a AS (SELECT job, engine, floor(avg(ndcg_10) * 1e6 + 0.5e0) / 1e6 AS ndcg, floor(avg(ap) * 1e6 + 0.5e0) / 1e6 AS map FROM m WHERE judged GROUP BY ALL) SELECT job, engine, ndcg, map, ndcg = max(ndcg) OVER (PARTITION BY job) AS best_ndcg, map = max(map) OVER (PARTITION BY job) AS best_map FROM a")
def best_engines(spark, d):
    """The highest mean of each column marked."""
    a = V.aggregate(_derived(spark, d), _derived_metrics(spark, d)).select("job", "engine", _r6("mean_ndcg_10").alias("ndcg"), _r6("mean_ap").alias("map"))
    return V.best_per_column(a, ["ndcg", "map"])


@_query("""WITH s AS (SELECT job, engine, floor(score * 1e6)::BIGINT + rank AS ns FROM runs WHERE rank IS NOT NULL AND (job, query_id, engine) NOT IN (SELECT (job, query_id, engine) FROM runs WHERE error IS NOT NULL))
SELECT job, engine, count(*) AS n, min(ns) AS min, max(ns) AS max, floor(quantile_cont(ns, 0.5))::BIGINT AS p50, floor(quantile_cont(ns, 0.95))::BIGINT AS p95 FROM s GROUP BY ALL""")
def engine_latency(spark, d):
    """Latency over all samples of an engine, failed executions left out; the runs' scores stand in for samples."""
    runs = table(spark, d, "runs")
    samples = runs.where("rank IS NOT NULL").select("job", "query_id", "engine", (F.floor(F.col("score") * 1e6) + F.col("rank")).alias("ns"))
    a = V.aggregate(runs, _metrics(spark, d), samples=samples).where("latency_n IS NOT NULL")
    return a.select("job", "engine", *[F.col(f"latency_{c}").alias(c) for c in ("n", "min", "max", "p50", "p95")])


@_query("WITH c AS (SELECT 'articles' AS engine, count(DISTINCT id) AS articles FROM articles UNION ALL SELECT 'vectors', count(DISTINCT article_id) FROM article_embeddings) SELECT engine, articles, min(articles) OVER () = max(articles) OVER () AS agrees FROM c")
def corpus_check(spark, d):
    """Whether all engines search as many articles."""
    c = table(spark, d, "articles").agg(F.lit("articles").alias("engine"), F.count_distinct("id").alias("articles"))
    v = table(spark, d, "article_embeddings").agg(F.lit("vectors").alias("engine"), F.count_distinct("article_id").alias("articles"))
    return V.same_corpus(c.unionByName(v))


@_query(f"WITH {_POOL}, k AS (SELECT query_id, doc_id, max(grade) AS grade FROM qrels WHERE grade >= 0 GROUP BY ALL), t AS (SELECT query_id, doc_id, k.grade FROM pool LEFT JOIN k USING (query_id, doc_id)) SELECT query_id, doc_id, coalesce(grade, CASE WHEN doc_id IN (SELECT id FROM articles WHERE id < '8') THEN 1 ELSE -1 END)::INT AS grade FROM t")
def judge_run(spark, d):
    """Grades kept from before, the judge's for the rest, -1 where the article is missing; half of the articles are hidden here."""
    some = table(spark, d, "articles").where("id < '8'")
    kept = V.grades(table(spark, d, "qrels"))
    return JR.run(V.pool(table(spark, d, "runs")), some, lambda texts: texts.select("query_id", "doc_id", F.lit(1).alias("grade")), kept)


_UUID = "regexp_matches(article_id, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')"


@_query(f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce({_UUID}, false)) AS bad_ids, count(*) FILTER (WHERE {_UUID} AND embedding IS NULL) AS null_vectors, count(*) FILTER (WHERE {_UUID} AND len(embedding) <> {DIM}) AS bad_dim, count(*) FILTER (WHERE {_UUID} AND len(embedding) = {DIM}) AS to_load FROM article_embeddings")
def embedding_validation(spark, d):
    return E.validation(table(spark, d, "article_embeddings"))


@_query(f"SELECT article_id, model_name, epoch_us(max(created_at)) AS created_us FROM article_embeddings WHERE {_UUID} AND len(embedding) = {DIM} AND article_id IN (SELECT id FROM articles) GROUP BY article_id, model_name")
def embedding_upsert(spark, d):
    """The older half of the vectors, then all of them as a batch: one row per article and model, the latest."""
    rows = E.valid(table(spark, d, "article_embeddings"))
    articles = table(spark, d, "articles")
    old = E.upsert(rows.limit(0), rows.where(F.minute("created_at") < 30), articles)
    return E.upsert(old, rows, articles).select("article_id", "model_name", F.unix_micros("created_at").alias("created_us"))


@_query("SELECT DISTINCT article_id FROM article_embeddings WHERE article_id IS NOT NULL AND article_id NOT IN (SELECT id FROM articles)")
def embedding_orphans(spark, d):
    return E.orphans(table(spark, d, "article_embeddings").where("article_id IS NOT NULL"), table(spark, d, "articles")).select("article_id").distinct()


@_query(r"SELECT DISTINCT id, CASE WHEN regexp_matches(trim(url), '^[hH][tT][tT][pP][sS]?://[^/?#\s]+') THEN trim(url) ELSE '' END AS url FROM articles")
def url_normalize(spark, d):
    return table(spark, d, "articles").select("id", files.normalize_url(F.coalesce("url", F.lit(""))).alias("url")).distinct()


@_query(r"""SELECT DISTINCT id, epoch_us(try_cast(replace(rtrim(trim(published_at), 'Z'), 'T', ' ') AS TIMESTAMP)) AS us FROM articles
WHERE regexp_matches(trim(published_at), '^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$') AND trim(published_at) >= '0001-01-02' AND try_cast(replace(rtrim(trim(published_at), 'Z'), 'T', ' ') AS TIMESTAMP) IS NOT NULL""")
def datetime_fallbacks(spark, d):
    """Date and time layouts tried in turn, without zones; datetime_fallbacks_all has all layouts."""
    t = F.trim("published_at")
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$") & (t >= "0001-01-02")
    plain = F.regexp_replace(F.regexp_replace(t, "Z$", ""), "T", " ")
    forms = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss"]
    ts = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in forms], plain.try_cast("timestamp"))
    return table(spark, d, "articles").where(shape).select("id", F.unix_micros(ts).alias("us")).where("us IS NOT NULL").distinct()


@_query(r"""WITH t AS (SELECT DISTINCT id, trim(published_at) AS t FROM articles),
p AS (SELECT id, regexp_extract(t, '^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})', 1) || ' ' || regexp_extract(t, '^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})', 2) AS local,
regexp_extract(t, '[.,](\d+)', 1) AS f, regexp_extract(t, '([+-]\d{2}:\d{2})$', 1) AS z FROM t
WHERE regexp_matches(t, '^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}([.,]\d+)?Z?|T\d{2}:\d{2}:\d{2}([.,]\d+)?[+-]\d{2}:\d{2})$') AND t >= '0001-01-02'),
o AS (SELECT *, CASE WHEN z = '' THEN 0 ELSE z[2:3]::BIGINT END AS h, CASE WHEN z = '' THEN 0 ELSE z[5:6]::BIGINT END AS m FROM p)
SELECT id, epoch_us(try_cast(local AS TIMESTAMP)) + rpad(f[1:6], 6, '0')::BIGINT - CASE WHEN z[1:1] = '-' THEN -1 ELSE 1 END * (h * 60 + m) * 60000000 AS us
FROM o WHERE try_cast(local AS TIMESTAMP) IS NOT NULL AND h <= 24 AND m <= 60 GROUP BY ALL""")
def datetime_fallbacks_all(spark, d):
    """All fallback layouts: fractions of any length, cut to microseconds, and after a T also offsets, which are applied; local values are UTC."""
    t = F.trim("published_at")
    clock = r"\d{2}:\d{2}:\d{2}([.,]\d+)?"
    shape = t.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}([ T]{clock}Z?|T{clock}[+-]\d{{2}}:\d{{2}})\z") & (t >= "0001-01-02")
    offset = F.regexp_extract(t, r"([+-]\d{2}:\d{2})\z", 1)
    hours, minutes = (F.coalesce(F.substring(offset, k, 2).try_cast("long"), F.lit(0)) for k in (2, 5))
    fraction = F.rpad(F.substring(F.regexp_extract(t, r"[.,](\d+)", 1), 1, 6), 6, "0").cast("long")
    local = F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 8), F.lit("+00:00")).try_cast("timestamp")
    us = F.unix_micros(local) + fraction - F.when(offset.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes) * 60_000_000
    return table(spark, d, "articles").where(shape & (hours <= 24) & (minutes <= 60)).select("id", us.alias("us")).where("us IS NOT NULL").distinct()


_ISO = "strftime(timezone('UTC', {}), '%Y-%m-%dT%H:%M:%S.%fZ')"


@_query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in ("id", "title", "subtitle", "content", "author", "description", "url", "language", "published_at")) + f", {_ISO.format('created_at')} AS created_at, nullif(metadata.source_id, '') AS source_id, nullif(metadata.source_name, '') AS source_name, nullif(metadata.category, '') AS category, {_ISO.format('metadata.imported_at')} AS imported_at FROM articles")
def canonical_records(spark, d):
    """The flat interchange record of every row; times rendered as text."""
    return files.canonical(table(spark, d, "articles"))


@_query("SELECT id, title, subtitle, content, author, description, url, language, published_at, timezone('UTC', created_at)::VARCHAR AS created_at, metadata.source_id AS \"metadata.source_id\", metadata.source_name AS \"metadata.source_name\", metadata.category AS \"metadata.category\", timezone('UTC', metadata.imported_at)::VARCHAR AS \"metadata.imported_at\", to_json(metadata.extra)::VARCHAR AS \"metadata.extra\" FROM articles")
def flattened_records(spark, d):
    """Every leaf of the nested article rows as text under its dotted name."""
    return files.flattened(table(spark, d, "articles"))


@_query()
def corpus_sample_nested(spark, d):
    """A deterministic sample (the hash has no counterpart in SQL)."""
    return files.nested_sample(table(spark, d, "articles").select("id").distinct(), "id", 100)


@_query(f"SELECT model_name, count(DISTINCT id) AS vectors FROM article_embeddings WHERE len(embedding) = {DIM} AND model_name = '{MODEL}' GROUP BY model_name")
def model_filter(spark, d):
    return table(spark, d, "article_embeddings").where((F.size("embedding") == DIM) & (F.col("model_name") == MODEL)).groupBy("model_name").agg(F.count_distinct("id").alias("vectors"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
