"""Mixed timestamp notations and zones: one UTC instant per value, or none.

Every value yields the array of its interpretations, one per reading convention (``CONVENTIONS``): all-digit dates day first or month
first, and what else can be read in two ways (a repeated or skipped local hour, an abbreviation of two zones, the unit of a count
since 1970) in the usual or the other way. A value that doesn't depend on a convention has the same instant under both; an
impossible reading, such as month 25, is null: no instant.

A Viterbi pass over each source's record order chooses among them: a reading against the source's declared order costs ``PRIOR``,
the other way of what the rules settle ``RULE``, giving up a value that another reading explains ``NONE`` (nothing under the declared order: a date
that doesn't exist there has no instant), a change of convention between neighbours ``SWITCH`` each, a step backwards in time up to
``BACK``. Neighbours can save 5 at most by one reading, so a declared order or rule always prevails; where none speaks, the sequence does.

The pass is exact and distributed: records are sorted by range of (source, record order) into parts of about ``PART``. What a
source at a part's end needs of its neighbour parts is a min-plus matrix of its records there, over the conventions at its first and last one; the
matrices of a source are chained (a row per part, never per record), then all parts are resolved in parallel with their ends
fixed. Within a part, blocks of records go step by step side by side as arrays. A source with a third of all rows is so many parts.

Defined results: null, blank, placeholder, relative or impossible values, years 0 and 1 and local values without a known
zone give no instant; a repeated local hour means the earlier instant, a skipped one is read with the offset before the
change; digits beyond microseconds are cut. Repeated rows of an id give one row, rows without an id none. Rows without a source are read on their
own, all-digit dates day first.
"""

from __future__ import annotations

import re
from math import ceil, isqrt
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import materialize

PRIOR, RULE, NONE, SWITCH, BACK, LIKE_FIRST = 1000.0, 1000.0, 100.0, 1.0, 0.5, 1e-3
CONVENTIONS = (("dmy", "usual"), ("mdy", "usual"), ("dmy", "other"), ("mdy", "other"))
N, YEAR, PART = len(CONVENTIONS), 3.15e13, 500_000

# Month names of the supported languages, in calendar order.
MONTH_NAMES = (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "januar februar mart april maj jun jul avgust septembar oktobar novembar decembar",
    "јануар фебруар март април мај јун јул август септембар октобар новембар децембар",
)
MONTHS = {w: i + 1 for names in MONTH_NAMES for i, w in enumerate(names.split())} | {"sept": 9, "juni": 6, "juli": 7, "setiembre": 9, "jänner": 1}

# Minutes east of UTC of the usual zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# What some of them mean elsewhere.
OTHERWISE = {"IST": 120, "CST": 480, "BST": 360, "EST": 600, "MST": 480}

_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?(?:\s*(?:Uhr|uhr|h|часова|časova))?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s*(?P<abbr>[A-Z]{1,5})(?P<aoff>[+-]\d{1,2}(?::?\d{2})?)?)?(?:\s*\[(?P<zone>[A-Za-z_+\-/0-9]+)\])?(?:\s*\([A-Za-z ]+\))?"
_JOIN = r"(?:T|t|[\s,.]+(?:(?:à|at|um|u|у|a\s+las|-)\s+)?)"
_TAIL = rf"(?:{_JOIN}{_TIME})?{_ZONE}$"
_DAYNAME = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_FORMS = [
    re.compile(r"^(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})" + _TAIL),
    re.compile(r"^(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})\.?" + _TAIL),
    re.compile(r"^" + _DAYNAME + r"(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er)?\s*-?(?:de\s+)?(?P<name>[^\W\d_]{3,12})\.?,?\s*-?(?:de\s+|del\s+)?(?P<y>\d{4})\.?" + _TAIL),
    re.compile(r"^" + _DAYNAME + r"(?P<name>[^\W\d_]{3,12})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})" + _TAIL),
    re.compile(r"^(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?" + _ZONE + "$"),
]
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _minutes(text: str) -> int | None:
    sign, digits = (-1 if text[0] == "-" else 1), text[1:].replace(":", "")
    hours, minutes = int(digits[: 1 if len(digits) in (1, 3) else 2]), int(digits[-2:]) if len(digits) > 2 else 0
    return sign * (60 * hours + minutes) if hours <= 18 and minutes < 60 else None


def _instant(y: int, mo: int, d: int, g: dict, home: str | None, other: bool) -> int | None:
    """Microseconds since 1970 of one reading, in the usual or the other way, or None."""
    h, mi, s = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if half := g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half in "Pp" else 0)
    if y < 2:
        return None
    us = int((g.get("f") or "0")[:6].ljust(6, "0"))
    if g.get("off"):
        minutes = _minutes(g["off"])
        if minutes is None:
            return None
        tz = timezone(timedelta(minutes=minutes))
    elif g.get("abbr"):
        if (base := ABBREVIATIONS.get(g["abbr"])) is None:
            return None
        base = OTHERWISE.get(g["abbr"], base) if other else base
        more = _minutes(g["aoff"]) if g.get("aoff") else 0
        if more is None:
            return None
        tz = timezone(timedelta(minutes=base + more))
    else:
        tz = _zone(g.get("zone") or home or "")
        if tz is None:
            return None
    try:
        t = datetime(y, mo, d, h, mi, s, us, tzinfo=tz, fold=int(other)) - _EPOCH
    except (ValueError, OverflowError):
        return None
    return (t.days * 86_400 + t.seconds) * 1_000_000 + t.microseconds


def interpretations(value: str | None, home: str | None) -> list[int | None]:
    """The instants of a value under each of CONVENTIONS."""
    v = (value or "").strip()
    if not v:
        return [None] * N
    if v.isdigit() and v.isascii() and len(v) != 8 and not (len(v) == 14 and v[:2] in ("19", "20")):
        units = (1_000_000_000, 1_000_000, 1_000, 1)  # nanoseconds of seconds, milliseconds, microseconds, nanoseconds
        for k, longest in enumerate((11, 14, 17, 20)):
            if 8 < len(v) <= longest:
                usual, other = int(v) * units[k] // 1000, int(v) * units[min(k + 1, 3)] // 1000
                return [usual, usual, other, other]
        return [None] * N
    for k, form in enumerate(_FORMS):
        if not (m := form.match(v)):
            continue
        g = m.groupdict()
        y = int(g["y"])
        if k == 1:
            a, b = int(g["a"]), int(g["b"])
            return [_instant(y, mo, d, g, home, other) for other in (False, True) for mo, d in ((b, a), (a, b))]
        mo = MONTHS.get(g["name"].lower()) if "name" in g else int(g["mo"])
        if mo is None:
            continue
        usual, other = (_instant(y, mo, int(g["d"]), g, home, x) for x in (False, True))
        return [usual, usual, other, other]
    return [None] * N


_SWITCHES = np.array([[SWITCH * ((a ^ b) & 1) + SWITCH * ((a ^ b) >> 1) for b in range(N)] for a in range(N)])


def emissions(us: np.ndarray, ok: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """Cost of each reading by itself."""
    cost = np.zeros(us.shape)
    for s in range(N):
        order, other = s & 1, s >> 1
        depends = (ok[:, s] != ok[:, s ^ 1]) | (us[:, s] != us[:, s ^ 1])
        cost[:, s] = PRIOR * (depends & (declared >= 0) & (declared != order)) + LIKE_FIRST * (depends & (order == 1))
        cost[:, s] += NONE * (~ok[:, s] & (declared != order))
        if other:
            cost[:, s] += RULE * ((ok[:, s] != ok[:, s ^ 2]) | (us[:, s] != us[:, s ^ 2]))
    return cost


def transitions(p: np.ndarray, q: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Cost of each pair of readings of neighbours, instants as doubles with NaN for none; nothing between records that aren't linked."""
    back = (p[..., :, None] - q[..., None, :]) / YEAR
    return np.where(linked[..., None, None], _SWITCHES + BACK * np.clip(np.nan_to_num(back), 0, 1), 0.0)


class Lanes:
    """A sequence of records cut into blocks of about its square root, which go step by step side by side."""

    def __init__(self, t: np.ndarray, cost: np.ndarray, linked: np.ndarray):
        """t: instants as doubles; linked[k]: record k belongs to the source of record k - 1."""
        n = len(t)
        self.n, self.steps = n, max(1, isqrt(n))
        self.k = ceil(n / self.steps)
        more = self.k * self.steps - n
        shape = (self.k, self.steps, N)
        self.t = np.concatenate((t, np.full((more, N), np.nan))).reshape(shape)
        self.cost = np.concatenate((cost, np.zeros((more, N)))).reshape(shape)
        self.linked = np.concatenate((linked, np.zeros(more, bool))).reshape(shape[:2])

    def _step(self, b: int) -> np.ndarray:
        return transitions(self.t[:, b - 1], self.t[:, b], self.linked[:, b])

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """Per block the least cost from each state of its first record to each of its last; and the costs from a block to the next."""
        m = np.full((self.k, N, N), np.inf)
        m[:, range(N), range(N)] = self.cost[:, 0]
        for b in range(1, self.steps):
            m = (m[:, :, :, None] + self._step(b)[:, None]).min(2) + self.cost[:, b][:, None, :]
        return m, transitions(self.t[:-1, -1], self.t[1:, 0], self.linked[1:, 0])

    def product(self) -> np.ndarray:
        """The same from the first record to the last one."""
        m, between = self.matrices()
        out = m[0]
        for k in range(1, self.k):
            out = _times(_times(out, between[k - 1]), m[k])
        return out

    def states(self) -> np.ndarray:
        """The cheapest state of every record."""
        first, last = chain(*self.matrices())
        cost = np.full((self.k, N), np.inf)
        rows = np.arange(self.k)
        cost[rows, first] = self.cost[rows, 0, first]
        came = np.zeros((self.steps, self.k, N), np.int8)
        for b in range(1, self.steps):
            options = cost[:, :, None] + self._step(b)
            came[b] = options.argmin(1)
            cost = options.min(1) + self.cost[:, b]
        out = np.zeros((self.k, self.steps), np.int64)
        state = last
        for b in range(self.steps - 1, -1, -1):
            out[:, b] = state
            state = came[b][rows, state].astype(np.int64)
        return out.reshape(-1)[: self.n]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(1)


def chain(matrices: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states of the first and last record of each matrix on the cheapest way through all of them."""
    enter, came, via = np.zeros(N), [], []
    for k, m in enumerate(matrices):
        options = enter[:, None] + m
        via.append(options.argmin(0))
        left = options.min(0)
        if k < len(between):
            options = left[:, None] + between[k]
            came.append(options.argmin(0))
            enter = options.min(0)
    state, first, last = int(left.argmin()), [], []
    for k in range(len(matrices) - 1, -1, -1):
        last.append(state)
        first.append(int(via[k][state]))
        state = int(came[k - 1][first[-1]]) if k else 0
    return np.array(first[::-1]), np.array(last[::-1])


_US = [f"us{k}" for k in range(N)]
_LONGS = ", ".join(f"{c} long" for c in _US)
_ORDERED = f"src string, id string, declared int, {_LONGS}, part int, seq long, ends array<double>"


def _read(batches):
    for g in batches:
        got = [interpretations(v, z) for v, z in zip(g["value"], g["home_zone"])]
        for k, c in enumerate(_US):
            g[c] = pd.array([r[k] for r in got], dtype="Int64")
        yield g[["id", "src", "at", "declared", *_US]]


def _arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Instants, which of them there are, and as doubles; the costs; and which record continues the source of the one before."""
    us = np.stack([t[c].fill_null(0).to_numpy() for c in _US], 1)
    ok = np.stack([t[c].is_valid().to_numpy() for c in _US], 1)
    src = t["src"].combine_chunks().dictionary_encode().indices.to_numpy()
    linked = np.append(False, src[1:] == src[:-1])[: len(src)]
    return us, ok, np.where(ok, us, np.nan).astype(float), emissions(us, ok, t["declared"].to_numpy()), linked


def _summarise(batches):
    """Numbers a part's records, and adds for the first and the last source in it a row with its matrix and the instants at its ends."""
    batches = list(batches)
    if not batches or not (t := pa.Table.from_batches(batches)).num_rows:
        return
    n, part = t.num_rows, TaskContext.get().partitionId()
    _, _, x, cost, linked = _arrays(t)
    yield from pa.Table.from_arrays([*(t[c] for c in ("src", "id", "declared", *_US)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n)), pa.nulls(n, pa.list_(pa.float64()))], [c.split()[0] for c in _ORDERED.split(", ")]).to_batches()
    begins = np.flatnonzero(~linked)
    pieces = {(0, int(begins[1]) if len(begins) > 1 else n), (int(begins[-1]), n)}
    ends = [[*Lanes(x[a:b], cost[a:b], linked[a:b] & (np.arange(a, b) > a)).product().ravel(), *x[a], *x[b - 1]] for a, b in pieces]
    src = pa.array([t["src"][a].as_py() for a, _ in pieces], pa.string())
    k = len(pieces)
    yield pa.RecordBatch.from_arrays([src, pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.int64())] * N, pa.array(np.full(k, part, np.int32)), pa.nulls(k, pa.int64()), pa.array(ends, pa.list_(pa.float64()))], [c.split()[0] for c in _ORDERED.split(", ")])


def _chained(g: pd.DataFrame) -> pd.DataFrame:
    """Of one source: the states of its first and last record in each part."""
    g = g.sort_values("part")
    e = np.stack(g["ends"].to_numpy())
    first, last = e[:, N * N : N * N + N], e[:, N * N + N :]
    a, b = chain(e[:, : N * N].reshape(-1, N, N), transitions(last[:-1], first[1:], np.ones(len(e) - 1, bool)))
    return pd.DataFrame({"src": g["src"], "part": g["part"], "first": a.astype(np.int32), "last": b.astype(np.int32)})


def _resolve(t: pa.Table) -> pa.Table:
    t = t.sort_by("seq")
    us, ok, x, cost, linked = _arrays(t)
    fixed = {r["src"]: r for r in t["fixed"][0].as_py()}
    begins = np.flatnonzero(~linked)
    for a, b in {(0, int(begins[1]) if len(begins) > 1 else len(us)), (int(begins[-1]), len(us))}:
        r = fixed[t["src"][a].as_py()]
        for at, state in ((a, r["first"]), (b - 1, r["last"])):
            cost[at, np.arange(N) != state] = np.inf
    state = Lanes(x, cost, linked).states()
    rows = np.arange(len(us))
    return pa.table({"id": t["id"], "published_us": pa.array(us[rows, state], mask=~ok[rows, state])})


def resolve_instants(rows: DataFrame, sources: DataFrame, use_declared_order: bool = True) -> DataFrame:
    """rows(id, value, source, at) and sources(source, home_zone, date_order) to (id, published_us).

    ``source`` is compared without regard to case and surrounding blanks; ``at`` gives the record order. With
    use_declared_order=False the declared order is ignored and the sequence alone decides.
    """
    key = lambda c: F.expr(f"nullif(lower(regexp_replace({c}, '^\\\\s+|\\\\s+$', '')), '')")
    known = sources.select(key("source").alias("src"), "home_zone", "date_order").where("src IS NOT NULL").dropDuplicates(["src"])
    declared = F.expr("CASE date_order WHEN 'dmy' THEN 0 WHEN 'mdy' THEN 1 ELSE -1 END") if use_declared_order else F.lit(-1)
    read = (
        rows.where("value IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("string"), "value", key("source").alias("src"), F.col("at").cast("timestamp").alias("at"))
        .join(known, "src", "left")
        .select("id", "src", "at", "value", "home_zone", declared.alias("declared"))
        .mapInPandas(_read, f"id string, src string, at timestamp, declared int, {_LONGS}")
        .where(" OR ".join(f"{c} IS NOT NULL" for c in _US))
    )
    read = materialize(read, "interpretations")
    alone = read.where("src IS NULL").select("id", F.coalesce("us0", "us1").alias("published_us"))
    sourced = read.where("src IS NOT NULL")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(sourced.count() / PART))
    order = ["src", "at", "id", *_US]
    ordered = materialize(sourced.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("src", "id", "declared", *_US).mapInArrow(_summarise, _ORDERED), "ordered")
    ends = ordered.where("ends IS NOT NULL").select("src", "part", "ends").groupBy("src").applyInPandas(_chained, "src string, part int, first int, last int")
    fixed = ends.groupBy("part").agg(F.collect_list(F.struct("src", "first", "last")).alias("fixed"))
    chosen = ordered.where("ends IS NULL").drop("ends").join(fixed, "part").groupBy("part").applyInArrow(_resolve, "id string, published_us long")
    return chosen.unionByName(alone).where("published_us IS NOT NULL").groupBy("id").agg(F.min("published_us").alias("published_us"))
