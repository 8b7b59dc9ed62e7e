"""Ranking metrics, pooling, aggregation and significance over runs and relevance grades, all as grouped plans.

runs(job, query_id, category, engine, rank, doc_id, score, error), qrels(judge, query_id, doc_id, grade). A failed execution has
null rank and document. Grade -1 means unjudged. Repeated grades of a document count once (the highest).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS, THRESHOLD, DEPTH = (3, 5, 10), 1, 50
KEYS = ("job", "query_id", "engine")


def grades(qrels: DataFrame, judge: str | None = None) -> DataFrame:
    """(query_id, doc_id, grade) of one judge, or the highest of all; unjudged documents are left out."""
    q = qrels.where("grade >= 0")
    q = q.where(F.col("judge") == judge) if judge else q
    return q.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def of_jobs(runs: DataFrame, names: list[str]) -> DataFrame:
    """The runs of the named jobs; of all if none are named. A name that no run has is an error."""
    if not names:
        return runs
    known = {r["job"] for r in runs.where(F.col("job").isin(*names)).select("job").distinct().collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no job {missing[0]}")
    return runs.where(F.col("job").isin(*names))


def executions(runs: DataFrame) -> DataFrame:
    """A row per job, query and engine: whether it failed."""
    return runs.groupBy("job", "query_id", "engine").agg(F.max("category").alias("category"), F.max(F.col("error").isNotNull()).alias("failed"))


def ranked(runs: DataFrame, judged: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The ranked documents with their grades; rel marks those of at least the threshold."""
    r = runs.where("rank IS NOT NULL AND doc_id IS NOT NULL").select(*KEYS, "rank", "doc_id")
    return r.join(judged, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce(F.col("grade") >= threshold, F.lit(False)))


def ideal(judged: DataFrame, ks=KS, threshold: int = THRESHOLD) -> DataFrame:
    """Per query: relevant documents and the gain of the best possible order at each K."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    good = judged.where(F.col("grade") >= threshold).withColumn("r", F.row_number().over(w))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1)
    return good.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("r") <= k, gain)).alias(f"ideal_{k}") for k in ks])


def per_query(runs: DataFrame, judged: DataFrame, ks=KS, threshold: int = THRESHOLD) -> DataFrame:
    """All metrics of every execution that didn't fail, one row each; judged tells whether the query has any grade."""
    r = ranked(runs, judged, threshold)
    order = Window.partitionBy(*KEYS).orderBy("rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("hits", F.sum(F.col("rel").cast("int")).over(so_far)).withColumn("misses", F.sum((F.col("grade").isNotNull() & ~F.col("rel")).cast("int")).over(so_far))
    totals = ideal(judged, ks, threshold)
    r = r.join(totals.select("query_id", "relevant"), "query_id", "left")
    gain = F.when(F.col("rel"), (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1))
    n = F.coalesce("relevant", F.lit(0))
    sums = r.groupBy(*KEYS).agg(
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias(f"dcg_{k}") for k in ks],
        *[F.count_if(F.col("rel") & (F.col("rank") <= k)).alias(f"found_{k}") for k in ks],
        F.coalesce(F.sum(F.when(F.col("rel"), F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("rel"), 1 - F.least("misses", n) / n)), F.lit(0.0)).alias("preferences"),
    )
    done = executions(runs).where("NOT failed").join(sums, list(KEYS), "left").join(totals, "query_id", "left")
    done = done.join(judged.select("query_id").distinct().withColumn("judged", F.lit(True)), "query_id", "left")
    out = [F.coalesce("judged", F.lit(False)).alias("judged")]
    for k in ks:
        p, rec = F.coalesce(F.col(f"found_{k}"), F.lit(0)) / k, F.when(n > 0, F.coalesce(F.col(f"found_{k}"), F.lit(0)) / n).otherwise(0.0)
        out += [
            F.when(F.col(f"ideal_{k}") > 0, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"ideal_{k}")).otherwise(0.0).alias(f"ndcg_{k}"),
            p.alias(f"p_{k}"), rec.alias(f"r_{k}"), F.when(p + rec > 0, 2 * p * rec / (p + rec)).otherwise(0.0).alias(f"f1_{k}"),
        ]
    out += [
        F.when(n > 0, F.coalesce("precisions", F.lit(0.0)) / n).otherwise(0.0).alias("ap"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(n > 0, F.coalesce("preferences", F.lit(0.0)) / n).otherwise(0.0).alias("bpref"),
    ]
    return done.select(*KEYS, "category", *out)


def long_form(metrics: DataFrame) -> DataFrame:
    """(job, query_id, engine, category, judged, metric, value)."""
    names = [c for c in metrics.columns if c not in (*KEYS, "category", "judged")]
    stack = ", ".join(f"'{c}', {c}" for c in names)
    return metrics.select(*KEYS, "category", "judged", F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))


def aggregate(runs: DataFrame, metrics: DataFrame, by: tuple[str, ...] = ("job", "engine"), samples: DataFrame | None = None) -> DataFrame:
    """Counts of queries, errors and judged queries, and the mean and sample deviation of every metric over judged queries.

    With samples(job, query_id, engine, ns) also the latency over all samples of executions that didn't fail.
    """
    counts = executions(runs).groupBy(*by).agg(F.count("*").alias("queries"), F.count_if("failed").alias("errors"))
    names = [c for c in metrics.columns if c not in (*KEYS, "category", "judged")]
    means = metrics.where("judged").groupBy(*by).agg(
        F.count("*").alias("judged"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.stddev_samp(c).alias(f"sd_{c}") for c in names if c.startswith("ndcg")]
    )
    out = counts.join(means, list(by), "left").withColumn("judged", F.coalesce("judged", F.lit(0)))
    if samples is not None:
        good = samples.join(executions(runs).where("NOT failed").drop("failed"), list(KEYS), "inner")
        stats = latency(good, by, "ns")
        out = out.join(stats.select(*by, *[F.col(c).alias(f"latency_{c}") for c in stats.columns if c not in by]), list(by), "left")
    return out


def best_per_column(aggregated: DataFrame, columns: list[str], over: tuple[str, ...] = ("job",)) -> DataFrame:
    """Adds best_<column> for each: whether no other engine of the job has a higher value; null values are never best."""
    w = Window.partitionBy(*over)
    return aggregated.withColumns({f"best_{c}": F.coalesce(F.col(c) == F.max(c).over(w), F.lit(False)) for c in columns})


def by_category(runs: DataFrame, metrics: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The same by category, for jobs with at least two of them; with order(query_id, position) also ``place``, where a category is first seen."""
    several = executions(runs).groupBy("job").agg(F.count_distinct("category").alias("c")).where("c > 1").select("job")
    out = aggregate(runs, metrics, ("job", "category", "engine")).join(several, "job", "left_semi")
    if order is None:
        return out
    seen = runs.select("job", "category", "query_id").distinct().join(order, "query_id").groupBy("job", "category").agg(F.min("position").alias("place"))
    return out.join(seen, ["job", "category"], "left")


def pool(runs: DataFrame, depth: int = DEPTH, jobs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, sources): documents of the first ``depth`` ranks over all engines and jobs.

    For each engine the first job counts: by jobs(job, position), which also leaves out jobs that it doesn't name, else by name.
    """
    ok = runs.where("error IS NULL AND doc_id IS NOT NULL")
    if jobs is None:
        first = ok.groupBy("query_id", "engine").agg(F.min("job").alias("job"))
    else:
        first = ok.join(jobs, "job").groupBy("query_id", "engine").agg(F.min_by("job", F.struct("position", "job")).alias("job"))
    kept = ok.where(F.col("rank") <= depth).join(first, ["query_id", "engine", "job"], "left_semi")
    return kept.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("engine")).alias("sources"))


def pool_summary(pooled: DataFrame) -> DataFrame:
    """Per query: documents, source hits and the share saved by pooling."""
    s = pooled.groupBy("query_id").agg(F.count("*").alias("docs"), F.sum(F.size("sources")).alias("hits"))
    return s.withColumn("dedup", F.floor((1 - F.col("docs") / F.col("hits")) * 1e4 + 0.5) / 1e4)


def grade_histogram(qrels: DataFrame) -> DataFrame:
    """Per judge and query: how many documents have each grade."""
    g = qrels.distinct()
    return g.groupBy("judge", "query_id").agg(*[F.count_if(F.col("grade") == k).alias(f"grade_{k}" if k >= 0 else "unjudged") for k in (-1, 0, 1, 2, 3)], F.count_if(F.col("grade") >= 0).alias("graded"))


def latency(samples: DataFrame, by: str | tuple[str, ...], value: str) -> DataFrame:
    """Whole-number statistics of samples: extremes, mean, deviation and interpolated percentiles."""
    ps, by = (50, 75, 90, 95, 99), (by,) if isinstance(by, str) else by
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.avg(value)).alias("mean"), F.floor(F.stddev_samp(value)).alias("sd"),
        F.percentile(value, F.array(*[F.lit(p / 100) for p in ps])).alias("p"),
    ).select(*by, "n", "min", "max", "mean", "sd", *[F.floor(F.col("p")[i]).alias(f"p{p}") for i, p in enumerate(ps)])


def wilcoxon(metrics: DataFrame, names: tuple[str, ...] = ("ndcg_5", "ndcg_10", "ap", "rr")) -> DataFrame:
    """Signed-rank statistics of every pair of engines per job and metric: n, w, ties, z. Fewer than 4 differing pairs give no row."""
    m = long_form(metrics).where(F.col("judged") & F.col("metric").isin(*names)).select("job", "query_id", "engine", "metric", "value")
    a = m.select("job", "query_id", "metric", F.col("engine").alias("engine_a"), F.col("value").alias("x"))
    b = m.select("job", "query_id", "metric", F.col("engine").alias("engine_b"), F.col("value").alias("y"))
    d = a.join(b, ["job", "query_id", "metric"]).where("engine_a < engine_b").withColumn("d", F.floor((F.col("x") - F.col("y")) * 1e9 + 0.5) / 1e9).where("d <> 0")
    keys = ["job", "engine_a", "engine_b", "metric"]
    w = Window.partitionBy(*keys, F.abs("d"))
    d = d.withColumn("t", F.count("*").over(w)).withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(F.abs("d"))) + (F.col("t") - 1) / 2.0)
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"),
        F.sum((F.col("t") * F.col("t") - 1) / 48.0).alias("ties"),
    ).where("n >= 4")
    n = F.col("n")
    s = s.withColumn("w", F.least("up", "down")).withColumn("variance", n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties"))
    z = F.when(F.col("variance") > 0, (F.col("w") - n * (n + 1) / 4.0 + 0.5) / F.sqrt("variance")).otherwise(0.0)
    return s.select(*keys, "n", "w", (F.floor(z * 1e6 + 0.5) / 1e6).alias("z"))


def p_value(z: float) -> float:
    """Two-sided, of the normal approximation."""
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def stars(p: float) -> str:
    return "**" if p < 0.01 else "*" if p < 0.05 else ""


def difference(metrics: DataFrame, base: str, other: str, name: str = "ndcg_10") -> DataFrame:
    """Two jobs side by side: (query_id, engine, before, after, delta); a null side is missing there."""
    one, two = (metrics.where(F.col("job") == j).select("query_id", "engine", F.col(name).alias(n)) for j, n in ((base, "before"), (other, "after")))
    return one.join(two, ["query_id", "engine"], "full").withColumn("delta", F.floor((F.col("after") - F.col("before")) * 1e6 + 0.5) / 1e6)


def significance(metrics: DataFrame, names: tuple[str, ...] = (*(f"ndcg_{k}" for k in KS), "ap", "rr")) -> DataFrame:
    """The matrix of all pairs of engines and metrics with p and stars; as many rows as pairs of engines."""
    tests = wilcoxon(metrics, names)

    def judge(batches):
        for g in batches:
            g["p"] = [p_value(z) for z in g["z"]]
            g["stars"] = [stars(p) for p in g["p"]]
            yield g

    return tests.mapInPandas(judge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tests.schema) + ", p double, stars string")


def regressions(metrics: DataFrame, base: str, other: str, name: str = "ndcg_10") -> DataFrame:
    """The queries of both jobs, the worst change first."""
    return difference(metrics, base, other, name).where("delta IS NOT NULL").orderBy("delta", "query_id", "engine")


def aggregate_difference(aggregated: DataFrame, base: str, other: str) -> DataFrame:
    """(engine, metric, before, after, delta) of the means of two jobs; an engine of one job only has a null on the other side."""
    names = [c for c in aggregated.columns if c.startswith("mean_")]
    stack = F.expr(f"stack({len(names)}, " + ", ".join(f"'{c.removeprefix('mean_')}', {c}" for c in names) + ") AS (metric, value)")
    one, two = (aggregated.where(F.col("job") == j).select("engine", stack).withColumnRenamed("value", n) for j, n in ((base, "before"), (other, "after")))
    return one.join(two, ["engine", "metric"], "full").withColumn("delta", F.floor((F.col("after") - F.col("before")) * 1e6 + 0.5) / 1e6)


def same_corpus(counts: DataFrame) -> DataFrame:
    """counts(engine, articles) with ``agrees``: whether all engines search as many articles."""
    w = Window.partitionBy(F.lit(1))
    return counts.withColumn("agrees", F.min("articles").over(w) == F.max("articles").over(w))
