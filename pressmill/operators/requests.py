"""Search requests as dictionaries: validated, turned into one query each, and answered page by page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pressmill.operators import retrieval as R

KINDS = ("match", "multi_match", "phrase", "boolean", "hybrid")
OPERATORS, LANGUAGES, FUZZINESS = ("and", "or"), ("english", "serbian"), {"AUTO": R.AUTO, "0": 0, "1": 1, "2": 2, "NONE": 0}


@dataclass(frozen=True)
class Hybrid:
    text: str
    k: int = R.RRF_K


@dataclass(frozen=True)
class Request:
    kind: str
    query: R.Match | R.Phrase | R.Boolean | Hybrid
    size: int
    after: tuple[float, str] | None


@dataclass(frozen=True)
class Page:
    hits: list[Row]
    has_more: bool
    next_cursor: str | None
    max_score: float
    page_max_score: float
    total_matches: int


def _choice(raw: dict, key: str, allowed, default: str) -> str:
    value = str(raw.get(key) or default)
    if value.lower() not in {x.lower() for x in allowed}:
        raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    return value


def _text(raw: dict, key: str = "query") -> str:
    text = raw.get(key)
    if not isinstance(text, str) or not text.strip():
        raise ValueError(f"{key} is required")
    return text


def _fields(names: list[str]) -> tuple[tuple[str, ...], dict[str, float]]:
    """Known fields and their weights; ``field^weight``, a void specification is left out."""
    parsed = [x for x in map(R.parse_field, names) if x]
    if unknown := [f for f, _ in parsed if f not in R.ALL_FIELDS]:
        raise ValueError(f"unknown field {unknown[0]}")
    if not parsed:
        raise ValueError("at least one field is required")
    return tuple(f for f, _ in parsed), dict(parsed)


def request_of(raw: dict) -> Request:
    """One query of exactly one kind, the page's size and the hit that it follows; ValueError says what is wrong."""
    given = raw.get("query")
    kinds = [k for k in KINDS if isinstance(given, dict) and given.get(k) is not None]
    if len(kinds) != 1:
        raise ValueError(f"the query must have exactly one of {', '.join(KINDS)}")
    kind, size = kinds[0], raw.get("size") or R.PAGE_DEFAULT
    if not isinstance(size, int) or not 1 <= size <= R.PAGE_MOST:
        raise ValueError(f"size must be between 1 and {R.PAGE_MOST}")
    q = given[kind]
    if kind == "boolean":
        expression = _text(q, "expression")
        R.boolean.parse(expression)
        query = R.Boolean(expression)
    elif kind == "phrase":
        slop = q.get("slop") or 0
        if not isinstance(slop, int) or not 0 <= slop <= R.MOST_SLOP:
            raise ValueError(f"slop must be between 0 and {R.MOST_SLOP}")
        query = R.Phrase(_text(q), _fields(q.get("fields") or list(R.FIELDS))[0], slop)
    elif kind == "hybrid":
        k = q.get("k") or R.RRF_K
        if not isinstance(k, int) or k < 1:
            raise ValueError("k must be at least 1")
        query = Hybrid(_text(q), k)
    else:
        names = [_text(q, "field")] if kind == "match" else q.get("fields") or list(R.FIELDS)
        fields, weights = _fields(names)
        weights |= {f: float(w) for f, w in (q.get("field_weights") or {}).items()}
        operator = _choice(q, "operator", OPERATORS, "and" if kind == "match" else "or").lower()
        fuzziness = FUZZINESS[_choice(q, "fuzziness", FUZZINESS, "0").upper()]
        query = R.Match(_text(q), fields, operator, weights, kind == "multi_match", fuzziness)
    _choice(q, "language", LANGUAGES, "english")
    return Request(kind, query, size, R.decode_cursor(raw["cursor"]) if raw.get("cursor") else None)


def page_of(hits: DataFrame, size: int = R.PAGE_DEFAULT, after: tuple[float, str] | None = None) -> Page:
    """hits(id, score): the page behind ``after``, the cursor of its last hit if there are more, and totals over all hits."""
    all_hits = hits.agg(F.max("score").alias("top"), F.count("*").alias("n")).first()
    rows = R.probe(hits, size, after).collect()
    more, shown = len(rows) > size, rows[:size]
    return Page(shown, more, R.encode_cursor(shown[-1]["score"], shown[-1]["id"]) if more else None, all_hits["top"] or 0.0, shown[0]["score"] if shown else 0.0, all_hits["n"])


def capabilities(semantic: bool = True) -> dict[str, bool]:
    """Which kinds of search there are; semantic ones need vectors."""
    return {"string_query": True, "match": True, "multi_match": True, "phrase": True, "boolean": True, "semantic": semantic, "hybrid": semantic}
