"""Benchmark specs and suites: templates, validation, timed runs, and reports in text, Markdown, HTML and JSON."""

from __future__ import annotations

import html
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from pressmill.functions.embedding import vector_literal

_HOLE = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")
PASSES = 5


@dataclass(frozen=True)
class Query:
    id: str
    description: str = ""
    category: str = ""
    engines: dict[str, dict] = field(default_factory=dict)  # engine to {"template": name, "params": {}} or {"sql": text}


@dataclass(frozen=True)
class Suite:
    id: str
    templates: dict[str, str]
    queries: list[Query]


@dataclass(frozen=True)
class Spec:
    id: str
    engines: list[str]
    ks: tuple[int, ...] = (3, 5, 10)
    threshold: int = 1
    warmup: int = 1
    runs: int = 3
    pool_depth: int = 100


def load(path: str | Path) -> dict:
    """A JSON artifact, or YAML where a parser is installed; schema_version must be 1."""
    text = Path(path).read_text()
    try:
        got = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: not JSON, and there is no YAML parser") from e
        got = yaml.safe_load(text)
    if got.get("schema_version", 1) != 1:
        raise ValueError(f"{path}: schema_version must be 1")
    return got


def suite_of(raw: dict) -> Suite:
    queries = [Query(q["id"], q.get("description", ""), q.get("category", ""), q.get("engines", {})) for q in raw.get("queries", [])]
    if len({q.id for q in queries}) < len(queries):
        raise ValueError("query ids must be unique")
    return Suite(raw["id"], {t["name"]: t["sql"] for t in raw.get("templates", [])}, queries)


def _shown(v: object) -> str:
    if isinstance(v, (list, tuple)) and v and all(isinstance(x, float) for x in v):
        return vector_literal(list(v))
    return ", ".join(map(_shown, v)) if isinstance(v, (list, tuple)) else str(v)


def render(template: str, values: dict) -> str:
    """Fills {{name}} holes, also those that values bring in, up to PASSES times; KeyError names what is missing."""
    for _ in range(PASSES):
        if not _HOLE.search(template):
            return template
        template = _HOLE.sub(lambda m: _shown(values[m.group(1)]), template)
    if _HOLE.search(template):
        raise KeyError("holes are left: " + ", ".join(_HOLE.findall(template)))
    return template


def vector_of(q: Query, engine: str, embed: Callable[[str], list[float]] | None) -> dict:
    """The query's vector as a parameter, if it asks for one; ValueError without an embedder."""
    text = q.engines[engine].get("embed")
    if text is None:
        return {}
    if embed is None:
        raise ValueError(f"{q.id} needs an embedder")
    return {"vector": [float(x) for x in embed(text)]}


def resolve(suite: Suite, q: Query, engine: str, values: dict | None = None) -> str:
    how = q.engines[engine]
    return render(how["sql"] if "sql" in how else suite.templates[how["template"]], how.get("params", {}) | (values or {}))


def run_sql(spark: SparkSession, text: str, args: dict | list | None = None, timeout: float | None = None, most: int = 10_000) -> list[dict]:
    """Rows of a query as dictionaries, ``most`` at most; beyond ``timeout`` seconds its jobs are cancelled and TimeoutError is raised."""
    if timeout is None:
        return [r.asDict(recursive=True) for r in spark.sql(text, args=args).limit(most).collect()]
    tag, late = f"query-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in spark.sql(text, args=args).limit(most).collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"cancelled after {timeout} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def validate(spark: SparkSession, suite: Suite, engines: list[str], embed: Callable[[str], list[float]] | None = None, supported: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(query, engine, status): analysed but not run. OK, SKIP, UNSUPPORTED, EMBED_ERR, TEMPLATE_ERR or INVALID.

    A query with an ``embed`` text needs its vector, as the parameter "vector".
    """
    out = []
    for q in suite.queries:
        for e in engines:
            if e not in q.engines:
                out.append((q.id, e, "SKIP"))
                continue
            if supported is not None and e not in supported:
                out.append((q.id, e, "UNSUPPORTED"))
                continue
            try:
                values = vector_of(q, e, embed)
            except Exception:
                out.append((q.id, e, "EMBED_ERR"))
                continue
            try:
                spark.sql(resolve(suite, q, e, values)).schema  # noqa: B018
                out.append((q.id, e, "OK"))
            except KeyError:
                out.append((q.id, e, "TEMPLATE_ERR"))
            except PySparkException:
                out.append((q.id, e, "INVALID"))
    return out


def run(spark: SparkSession, spec: Spec, suite: Suite, execute: Callable[[str], list[str]] | None = None, embed: Callable[[str], list[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, latency): every query on every engine, warmed up and timed serially; a failure is one row with its error.

    Only as many ids as are scored or pooled leave the plan.
    """
    most = max(spec.ks[-1], spec.pool_depth)
    execute = execute or (lambda text: [r[0] for r in spark.sql(text).limit(most).collect()])
    runs, latency = [], []
    for q in suite.queries:
        for e in (e for e in spec.engines if e in q.engines):
            try:
                text, ids = resolve(suite, q, e, vector_of(q, e, embed)), []
                for k in range(spec.warmup + spec.runs):
                    began = time.perf_counter_ns()
                    ids = execute(text)
                    if k >= spec.warmup:
                        latency.append((spec.id, q.id, e, k - spec.warmup, time.perf_counter_ns() - began))
                runs += [(spec.id, q.id, q.category, e, i + 1, str(d), None, None) for i, d in enumerate(ids[:most])]
            except (PySparkException, KeyError, ValueError) as x:
                runs.append((spec.id, q.id, q.category, e, None, None, None, str(x).split("\n")[0][:200]))
    return (
        spark.createDataFrame(runs, "job string, query_id string, category string, engine string, rank int, doc_id string, score double, error string"),
        spark.createDataFrame(latency, "job string, query_id string, engine string, run int, ns long"),
    )


def _cells(df: DataFrame, most: int = 1000) -> tuple[list[str], list[list[str]]]:
    """A report table; reports are small, more rows than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return df.columns, [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def as_markdown(df: DataFrame) -> str:
    head, rows = _cells(df)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows]) + "\n"


def as_text(df: DataFrame) -> str:
    head, rows = _cells(df)
    width = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in [head, *rows]) + "\n"


def as_html(df: DataFrame, title: str, bar: str | None = None) -> str:
    """A table, and a bar chart of one numeric column."""
    head, rows = _cells(df)
    cell = lambda tag, xs: "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cell('td', r)}</tr>" for r in rows)
    chart = ""
    if bar and rows:
        k = head.index(bar)
        values = [float(r[k] or 0) for r in rows]
        top = max(values) or 1.0
        bars = "".join(f'<rect x="0" y="{20 * i}" width="{300 * v / top:.1f}" height="16"><title>{html.escape(r[0])}: {v}</title></rect>' for i, (r, v) in enumerate(zip(rows, values)))
        chart = f'<svg width="320" height="{20 * len(rows)}">{bars}</svg>'
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{chart}<table><tr>{cell('th', head)}</tr>{body}</table>"


def as_json(df: DataFrame, run_id: str) -> dict:
    head, rows = _cells(df)
    return {"schema_version": 1, "run_id": run_id, "rows": [dict(zip(head, r)) for r in rows]}
