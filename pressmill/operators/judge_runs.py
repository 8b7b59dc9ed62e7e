"""Running judges over a pool: what is still to do, texts that are missing, language-model judges with batches, and grades kept per query."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNJUDGED, SNIPPET, WHOLE, BATCH = -1, 600, 1200, 8
GRADES = "query_id string, doc_id string, grade int"
RUBRIC = (
    "You grade how well news articles answer a search. 3: the article is about the topic. 2: it covers the topic. 1: it mentions the topic. "
    "0: it is about something else. Between two grades take the lower one. Answer with a JSON array only, an entry per article in their "
    'order: {"doc_id": "...", "grade": 0}'
)


@dataclass(frozen=True)
class JudgeName:
    """Who grades. Grades of different judges aren't put into one file."""

    strategy: str
    provider: str = ""
    model: str = ""
    prompt_version: str = ""


def check_resumable(kept: JudgeName, now: JudgeName) -> None:
    if kept != now:
        raise ValueError(f"grades by {kept} can't be continued by {now}")


class Model(Protocol):
    """Anything that answers a prompt with text; it is sent to the tasks."""

    def answer(self, rubric: str, prompt: str) -> str: ...


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, with dots behind if there were more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def prompt(description: str, docs: list[dict], constraint: str = "") -> str:
    """The articles of a batch, numbered; docs have id, title, description and content, already truncated."""
    out = ([constraint, ""] if constraint else []) + [f"Search: {description}", f"Articles: {len(docs)}", ""]
    for i, d in enumerate(docs, 1):
        out += [f"[{i}] doc_id: {d['id']}", f"Title: {d.get('title') or ''}"]
        out += [f"{name.capitalize()}: {d[name]}" for name in ("description", "content") if d.get(name)]
        out.append("")
    return "\n".join(out)


def _grade(entry: object) -> int | None:
    g = entry.get("grade") if isinstance(entry, dict) else None
    return g if type(g) is int and 0 <= g <= 3 else None


def parse_one(reply: str, doc_id: str) -> int:
    """The grade in the outermost braces of a reply; ValueError if it is none for this document."""
    a, b = reply.find("{"), reply.rfind("}")
    got = json.loads(reply[a : b + 1] if 0 <= a < b else reply)
    if not isinstance(got, dict) or got.get("doc_id") != doc_id:
        raise ValueError(f"the reply isn't about {doc_id}")
    if (g := _grade(got)) is None:
        raise ValueError("the grade must be a whole number from 0 to 3")
    return g


def parse_many(reply: str, doc_ids: list[str]) -> tuple[dict[str, int], list[str]]:
    """Grades by document from the outermost brackets of a reply, whatever surrounds them, and the documents left without one."""
    a, b = reply.find("["), reply.rfind("]")
    try:
        entries = json.loads(reply[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        entries = []
    got = {e.get("doc_id"): g for e in entries if (g := _grade(e)) is not None} if isinstance(entries, list) else {}
    return {d: got[d] for d in doc_ids if d in got}, [d for d in doc_ids if d not in got]


def with_articles(pooled: DataFrame, articles: DataFrame) -> DataFrame:
    """pooled(query_id, doc_id) with the articles' texts; ``missing`` where there is no such article."""
    own = articles.groupBy(F.col("id").alias("doc_id")).agg(*[F.max(c).alias(c) for c in ("title", "description", "content")], F.lit(False).alias("missing"))
    return pooled.join(own, "doc_id", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def run(pooled: DataFrame, articles: DataFrame, judge: Callable[[DataFrame], DataFrame], kept: DataFrame | None = None) -> DataFrame:
    """Grades of the whole pool: those kept from an earlier run, the judge's for the rest, -1 where the article is missing or the judge gives none."""
    todo = pooled.select("query_id", "doc_id").distinct()
    if kept is not None:
        kept = kept.select("query_id", "doc_id", "grade").join(todo, ["query_id", "doc_id"], "left_semi")
        todo = todo.join(kept, ["query_id", "doc_id"], "left_anti")
    texts = with_articles(todo, articles)
    graded = judge(texts.where("NOT missing").drop("missing")).select("query_id", "doc_id", "grade")
    new = todo.join(graded, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("grade", F.lit(UNJUDGED)).cast("int").alias("grade"))
    return new if kept is None else kept.unionByName(new)


def model_judge(model: Model, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A judge that asks a model about ``batch`` articles of a query at once, and singly about those it left out; no grade where that fails too."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for (query, text), rows in g.groupby(["query_id", "query_text"], sort=False):
                docs = rows.rename(columns={"doc_id": "id"}).to_dict("records")
                grades: dict[str, int] = {}
                for s in range(0, len(docs), batch):
                    some = docs[s : s + batch]
                    try:
                        got, left = parse_many(model.answer(RUBRIC, prompt(text, some)), [d["id"] for d in some])
                    except Exception:
                        got, left = {}, [d["id"] for d in some]
                    grades |= got
                    for d in (d for d in some if d["id"] in left):
                        try:
                            grades[d["id"]] = parse_one(model.answer(RUBRIC, prompt(text, [d])), d["id"])
                        except Exception:
                            continue
                yield pd.DataFrame({"query_id": query, "doc_id": list(grades), "grade": list(grades.values())})

    def judge(texts: DataFrame) -> DataFrame:
        cut = texts.select("query_id", "query_text", "doc_id", "title", "description", truncated(F.col("content"), SNIPPET).alias("content"))
        # a query's documents side by side; a query's pool is bounded by its depth and the number of engines
        return cut.repartition("query_id").sortWithinPartitions("query_id", "doc_id").mapInPandas(ask, GRADES)

    return judge


def save_grades(grades: DataFrame, path: str) -> None:
    """Grades as a table by query: what is there of a query is replaced, other queries stay."""
    grades.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query_id").parquet(path)
