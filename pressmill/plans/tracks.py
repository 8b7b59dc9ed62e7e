"""Folders of a benchmark: finding them, what they hold, provenance, the latest report, and housekeeping.

A track is a folder with spec and suite files (JSON, or YAML where a parser is installed), ``trec`` for pools and grades and ``reports``.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pressmill.plans import benchmarks as B
from pressmill.sources.files import write_atomically

LATEST, TOOL = "latest.json", "pressmill"
_SPECS, _SUITES = ("spec.json", "spec.yaml", "spec.yml"), ("suite.json", "suite.yaml", "suite.yml")


@dataclass(frozen=True)
class Track:
    root: Path

    def _first(self, names) -> Path | None:
        return next((self.root / n for n in names if (self.root / n).exists()), None)

    @property
    def spec(self) -> Path | None:
        return self._first(_SPECS)

    @property
    def suite(self) -> Path | None:
        return self._first(_SUITES)

    @property
    def complete(self) -> bool:
        return self.spec is not None and self.suite is not None

    @property
    def reports(self) -> Path:
        return self.root / "reports"

    @property
    def trec(self) -> Path:
        return self.root / "trec"


def resolve(where: str | None = None, root: str | Path = ".") -> list[Track]:
    """Tracks of a path, or of a pattern below root; without either the nearest track from here upwards."""
    root = Path(root).resolve()
    if where and set("*?[") & set(where):
        found = [Track(Path(p).resolve()) for p in sorted(glob.glob(str(root / where)))]
        found = [t for t in found if t.complete]
    elif where:
        found = [t for t in [Track((root / where).resolve())] if t.complete]
    else:
        found = [t for t in map(Track, [root, *root.parents]) if t.complete][:1]
    if not found:
        raise ValueError(f"no track at {where or root}")
    return found


def init(folder: str | Path, name: str) -> Track:
    """A new track with an empty suite; ValueError if there is one."""
    t = Track(Path(folder))
    if t.spec or t.suite:
        raise ValueError(f"{folder} is a track already")
    for d in (t.trec, t.reports):
        d.mkdir(parents=True, exist_ok=True)
    write_atomically(str(t.root / "spec.json"), {"schema_version": 1, "id": name, "engines": []})
    write_atomically(str(t.root / "suite.json"), {"schema_version": 1, "id": name, "templates": [], "queries": []})
    return t


def spec_of(raw: dict) -> B.Spec:
    """A spec with defaults for what isn't given; engines must be named once each."""
    engines = [e["name"] if isinstance(e, dict) else e for e in raw.get("engines", [])]
    if len(set(engines)) < len(engines):
        raise ValueError("engines must be named once each")
    d = B.Spec(raw["id"], engines)
    metrics, runs = raw.get("metrics", {}), raw.get("runs", {})
    return B.Spec(
        raw["id"], engines, tuple(metrics.get("k_values") or d.ks), metrics.get("relevance_threshold") or d.threshold, runs.get("warmup", d.warmup), runs.get("iterations") or d.runs,
        raw.get("pool", {}).get("depth") or d.pool_depth,
    )


def pool_of(spark: SparkSession, raw: dict) -> DataFrame:
    """(query_id, doc_id, sources) of a pool artifact."""
    rows = [(e["query_id"], d["doc_id"], sorted(d.get("sources", []))) for e in raw.get("queries", []) for d in e.get("docs", [])]
    return spark.createDataFrame(rows, "query_id string, doc_id string, sources array<string>")


def annotations_of(spark: SparkSession, raw: dict) -> DataFrame:
    """(query_id, doc_id, grade) of an annotations artifact; a grade outside -1 to 3 is an error."""
    rows = [(e["query_id"], d["doc_id"], d["grade"]) for e in raw.get("queries", []) for d in e.get("docs", [])]
    if bad := [r for r in rows if type(r[2]) is not int or not -1 <= r[2] <= 3]:
        raise ValueError(f"grade of {bad[0][1]} must be from -1 to 3")
    return spark.createDataFrame(rows, "query_id string, doc_id string, grade int")


def provenance(**known) -> dict:
    """What made an artifact, and when; what isn't known is left out."""
    now = datetime.now(UTC)
    own = {"run_id": f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}", "tool": TOOL, "generated_at": now.isoformat(timespec="seconds")}
    return own | {k: v for k, v in known.items() if v not in (None, "", [], {})}


def masked(connection: str, most: int = 50, shown: int = 20) -> str:
    """A long connection text by its ends."""
    return connection if len(connection) <= most else f"{connection[:shown]}...{connection[-shown:]}"


def duration(ns: int) -> str:
    """Nanoseconds in a unit that suits them; - for none."""
    if not ns:
        return "-"
    unit = next((u for u in ((1_000_000, 1_000, "µs", 1), (1_000_000_000, 1_000_000, "ms", 2)) if ns < u[0]), (0, 1_000_000_000, "s", 2))
    return f"{ns / unit[1]:.{unit[3]}f}{unit[2]}"


def _reports(t: Track) -> list[Path]:
    return sorted((p for p in t.reports.glob("*.json") if p.name != LATEST), reverse=True) if t.reports.is_dir() else []


def save_report(t: Track, report: dict) -> Path:
    """Writes a report under its run id, and the pointer to it."""
    t.reports.mkdir(parents=True, exist_ok=True)
    path = t.reports / f"{report['run_id']}.json"
    write_atomically(str(path), report)
    write_atomically(str(t.reports / LATEST), {"schema_version": 1, "run_id": report["run_id"], "file": path.name})
    return path


def latest_report(t: Track, nth: int = 0) -> Path:
    """The report the pointer names, or the nth before the last by name: run ids begin with the time."""
    pointer = t.reports / LATEST
    if nth == 0 and pointer.exists():
        return t.reports / B.load(pointer)["file"]
    found = _reports(t)
    if len(found) <= nth:
        raise ValueError(f"{t.reports} has {len(found)} reports, {nth + 1} are needed")
    return found[nth]


def status(t: Track) -> dict:
    """What of a track is there."""
    found = _reports(t)
    graded = sorted(p.name for p in t.trec.glob("annotations*")) if t.trec.is_dir() else []
    return {"spec": t.spec is not None, "suite": t.suite is not None, "pool": any(t.trec.glob("pool*")) if t.trec.is_dir() else False, "annotations": graded, "reports": len(found), "latest": found[0].stem if found else None}


def clean(t: Track, keep: int = 1, dry: bool = True) -> list[Path]:
    """Reports older than the ``keep`` last ones; they are deleted unless dry."""
    old = _reports(t)[keep:]
    if not dry:
        for p in old:
            os.remove(p)
    return old


def export(df: DataFrame, form: str, title: str = "") -> str:
    """A small result as Markdown, HTML or text."""
    if form not in ("markdown", "html", "text"):
        raise ValueError("form must be markdown, html or text")
    return B.as_markdown(df) if form == "markdown" else B.as_html(df, title) if form == "html" else B.as_text(df)
