"""Rows that fail to parse: loads the records that can be read, and names the reason for each of the others.

CSV records are indexed structurally: a mask of quotes over the bytes of a whole batch, its prefix parity, and from both
the delimiters and line ends outside quotes; column counts and quoting rules are then array comparisons. JSON lines must
be exactly one valid object. Required fields are checked in mapping order for presence, emptiness and type.

Defined results: a null record is ``read_failed``; so is a CSV record of a data set without mapping rows. A line end that
closes the record is ignored, any other outside quotes breaks it. Optional values that don't convert are left out, the
record stays. Extra keys are ignored. A later mapping of the same target overwrites an earlier one. Mapping tables are
configuration (``MOST_MAPPINGS`` rows at most); everything else is processed batch by batch without a shuffle.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.session import materialize
from pressmill.sources.mappings import mapping_faults

MOST_MAPPINGS = 10_000
READ_FAILED = "read_failed"
TRUE, FALSE = {"1", "t", "T", "TRUE", "true", "True"}, {"0", "f", "F", "FALSE", "false", "False"}
_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf(?:inity)?|nan)\Z", re.I)
_HEX_FLOAT = re.compile(r"[+-]?0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+\Z", re.I)
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")
_DATETIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})([ T])([0-9]{1,2}):([0-9]{2}):([0-9]{2})([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\Z")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_HOST = re.compile(r"(?:[^\x00-\x7f]|[A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>\"]|%(?:25|[89A-Fa-f][0-9A-Fa-f]))*\Z")
_USER = re.compile(r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*\Z")


def normalize_url(raw: str) -> str | None:
    """An absolute http(s) URL with a host, trimmed; None for anything else."""
    v = raw.strip()
    if not v or re.search(r"[\x00-\x1f\x7f]", v):
        return None
    v, _, fragment = v.partition("#")
    scheme, colon, rest = v.partition(":")
    if not colon or scheme.lower() not in ("http", "https") or _BAD_ESCAPE.search(fragment):
        return None
    rest = rest.partition("?")[0]
    if not rest.startswith("//"):
        return None
    authority, slash, path = rest[2:].partition("/")
    user, at, host = authority.rpartition("@")
    if at and not _USER.match(user) or _BAD_ESCAPE.search(slash + path) or not host:
        return None
    if host.startswith("["):
        inside, bracket, port = host.rpartition("]")
        if not bracket:
            return None
    else:
        inside, mark, port = host.rpartition(":")
        inside, port = (inside, mark + port) if mark else (host, "")
    if port and not re.match(r":[0-9]*\Z", port) or not _HOST.match(inside):
        return None
    return raw.strip()


def _day_exists(y: int, m: int, d: int) -> bool:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= m <= 12 and 1 <= d <= (29 if leap else 28) + (0 if m == 2 else 2 + (m in (1, 3, 5, 7, 8, 10, 12)) - leap)


def _date(v: str) -> str | None:
    m = _DATE.match(v)
    return v if m and _day_exists(*map(int, m.groups())) and v != "0001-01-01" else None


def _datetime(v: str) -> str | None:
    """A date and time with a blank (then without zone) or T between; the zero instant is no value."""
    if not (m := _DATETIME.match(v)):
        return None
    y, mo, d, mark, h, mi, s, fraction, zone = m.groups()
    if mark == " " and zone or not _day_exists(int(y), int(mo), int(d)) or int(h) > 23 or int(mi) > 59 or int(s) > 59:
        return None
    if zone and zone != "Z" and (int(zone[1:3]) > 24 or int(zone[4:]) > 60):
        return None
    if (y, mo, d) == ("0001", "01", "01") and int(h + mi + s) == 0 and not (fraction or "").strip(".,0") and zone in (None, "Z", "+00:00", "-00:00"):
        return None
    return v


def convert(value: str, kind: str) -> str | None:
    """The value as canonical text if it is one of its type, else None."""
    if kind == "string":
        return value
    if kind == "int":
        return str(int(value)) if _INT.match(value) and -(2**63) <= int(value) < 2**63 else None
    if kind == "float":
        if _HEX_FLOAT.match(value):
            try:
                return repr(float.fromhex(value))
            except OverflowError:
                return None
        if not _FLOAT.match(value):
            return None
        x = float(value)
        return repr(x) if not math.isinf(x) or "i" in value.lower() else None
    if kind == "bool":
        return "true" if value in TRUE else "false" if value in FALSE else None
    if kind == "date":
        return _date(value)
    if kind == "datetime":
        return _datetime(value)
    if kind == "uuid":
        v = value
        if len(v) == 45 and v[:9].lower() == "urn:uuid:":
            v = v[9:]
        elif len(v) == 38:
            v = v[1:37]
        elif len(v) == 32:
            v = "-".join((v[:8], v[8:12], v[12:16], v[16:20], v[20:]))
        return v.lower() if _UUID.match(v) else None
    if kind == "url":
        return normalize_url(value)
    return None


def _plain(v, nested: bool = False) -> str:
    """Text of a JSON value that is no string."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if v is None:
        return "<nil>"
    if isinstance(v, (int, float)):
        x = float(v)
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        text = repr(x)
        if "e" in text and 1e-5 < abs(x) < 1e-4:
            return text.replace("e-0", "e-")
        return text
    if isinstance(v, list):
        return "[" + " ".join(_plain(x, True) for x in v) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{_plain(v[k], True)}" for k in sorted(v)) + "]"
    return v


def _refuse(text: str):
    raise ValueError(text)


def _number(text: str) -> float:
    x = float(text)
    return x if not math.isinf(x) else _refuse(text)


def json_fields(raw: str | None) -> dict[str, str] | None:
    """Key to text of a record that is exactly one valid object, without null values; None if it isn't."""
    try:
        got = json.loads(raw, parse_constant=_refuse, parse_float=_number)
        return {k: _plain(v) for k, v in got.items() if v is not None} if type(got) is dict else None
    except (ValueError, TypeError, RecursionError, OverflowError):
        return None


def index_csv(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure of a batch of records: (readable, columns, field starts, field ends) over their joined bytes.

    Fields of record k are the next ``columns[k]`` of the arrays. A record is readable if every quote opens at a field's
    start, closes at its end, or is doubled inside, and if no line end lies outside quotes.
    """
    n = len(raws)
    size = np.fromiter(map(len, raws), np.int64, n)
    # every record is followed by one delimiter, so that records and fields end alike
    at = np.concatenate(([0], np.cumsum(size + 1)))
    b = np.frombuffer(b",".join([*raws, b""]), np.uint8)
    quote = b == 34
    before = np.concatenate(([0], np.cumsum(quote)))
    owner = np.repeat(np.arange(n), size + 1)
    odd = ((before[:-1] - before[at[:-1]][owner]) & 1).astype(bool)  # inside quotes, before this byte
    last = at[1:] - 1
    closed = ~odd[last]
    cut = (b == 44) & ~odd
    cut[last] = True
    ends = np.flatnonzero(cut)
    starts = np.concatenate(([0], ends[:-1] + 1))
    columns = np.bincount(owner[ends], minlength=n)
    first, final = np.zeros(len(b) + 1, bool), np.zeros(len(b) + 1, bool)
    first[starts], final[ends] = True, True
    left, right = np.concatenate(([False], quote[:-1])), np.concatenate((quote[1:], [False]))
    opens, closes = quote & ~odd, quote & odd
    bad = opens & ~(first[:-1] | left) | closes & ~(final[1:] | right) | ((b == 10) | (b == 13)) & ~odd
    broken = np.bincount(owner[bad], minlength=n) > 0
    return closed & ~broken, columns, starts, ends


def _csv_fields(raws: list[str | None]) -> list[list[str] | None]:
    data = []
    for r in raws:
        x = (r or "").encode("utf-8", "surrogatepass")
        data.append(x[:-2] if x.endswith(b"\r\n") else x[:-1] if x.endswith(b"\n") else x)
    good, columns, starts, ends = index_csv(data)
    whole, out, k = b",".join([*data, b""]), [], 0
    for r, ok, n in zip(raws, good.tolist(), columns.tolist()):
        if ok and r is not None:
            cells = [whole[s:e] for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist())]
            out.append([(c[1:-1].replace(b'""', b'"') if c[:1] == b'"' else c).decode("utf-8", "surrogatepass") for c in cells])
        else:
            out.append(None)
        k += n
    return out


RAW_FILE = "file string, block long, seq long, kind string, raw string"


def _is_whole(lines: list[str], width: int) -> np.ndarray:
    """Which lines are whole records by themselves, of the given width."""
    data = [x.encode("utf-8", "surrogatepass").removesuffix(b"\r") for x in lines]
    good, columns, _, _ = index_csv(data)
    return good & (columns == width)


class _Assembler:
    """Puts lines together to records: a record goes on while its quotes are open, until they close or a line comes that is whole by itself."""

    def __init__(self, width: int):
        self.width, self.held, self.odd = width, [], False

    def feed(self, lines: list[str]) -> list[str]:
        out = []
        # with one column any line would be whole by itself
        whole = _is_whole(lines, self.width) if self.width > 1 else np.zeros(len(lines), bool)
        parity = np.fromiter((x.count('"') & 1 for x in lines), bool, len(lines))
        for line, sure, odd in zip(lines, whole.tolist(), parity.tolist()):
            if self.held and not sure:
                self.held.append(line)
                self.odd ^= odd
                if not self.odd:
                    out += self.close()
                continue
            out += self.close()
            if odd:
                self.held, self.odd = [line], True
            else:
                out.append(line.removesuffix("\r"))
        return out

    def close(self) -> list[str]:
        """What is held, as one record without its line end."""
        out = ["\n".join(self.held).removesuffix("\r")] if self.held else []
        self.held = []
        return out


def raw_records(spark: SparkSession, path: str, width: int, header: bool = True) -> DataFrame:
    """Files of CSV as one raw record a row, (file, block, seq, raw), from splits of any place: no file is one task.

    Within a split the records' ends are where the parity of quotes says so. A line that is a record of ``width`` columns by itself begins a new
    one: so an open quote costs what lies before the next such line, not the rest of the file, and each split finds its first record by
    itself. What lies before that belongs to the split before; these pieces, two for a split at most, are put together per file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def assemble(batches):
        state: dict[tuple[str, int], list] = {}

        def frame(key, rows):
            return pd.DataFrame({"file": key[0], "block": key[1], "seq": [r[0] for r in rows], "kind": [r[1] for r in rows], "raw": [r[2] for r in rows]})

        for g in batches:
            for key, part in g.groupby(["file", "block"], sort=False):
                lines = part["value"].tolist()
                if key not in state:
                    state[key] = [_Assembler(width), 0, key[1] == 0, []]
                    if key[1] == 0 and header:
                        lines = lines[1:]
                a, seq, begun, head = state[key]
                if not begun:
                    whole = _is_whole(lines, width)
                    first = int(whole.argmax()) if whole.any() else len(lines)
                    head += lines[:first]
                    lines, begun = lines[first:], bool(whole.any())
                done = a.feed(lines) if lines else []
                if done:
                    yield frame(key, [(seq + k, "record", r) for k, r in enumerate(done)])
                state[key] = [a, seq + len(done), begun, head]
        for key, (a, seq, begun, head) in state.items():
            rows = ([(-1, "head", "\n".join(head))] if head else []) + ([(seq, "tail", "\n".join(a.held))] if a.held else []) + ([(0, "through", "")] if not begun else [])
            if rows:
                yield frame(key, rows)

    def join(g: pd.DataFrame) -> pd.DataFrame:
        """Of one file: open ends with the beginnings of the splits behind them."""
        g = g.sort_values(["block", "seq"])
        through = set(g.loc[g["kind"] == "through", "block"])
        out, a, at = [], _Assembler(width), (0, 0)
        for block, seq, kind, raw in zip(g["block"], g["seq"], g["kind"], g["raw"]):
            if kind == "tail" or kind == "head" and block == 0:
                out += [(*at, r) for r in a.close()]
                at = (block, seq)
            if kind != "through":
                out += [(*at, r) for r in a.feed(raw.split("\n"))]
            if kind == "head" and block not in through:
                out += [(*at, r) for r in a.close()]
        out += [(*at, r) for r in a.close()]
        return pd.DataFrame({"file": g["file"].iloc[0], "block": [x[0] for x in out], "seq": [x[1] for x in out], "raw": [x[2] for x in out]})

    found = materialize(lines.mapInPandas(assemble, RAW_FILE), "raw-records")
    edges = found.where("kind <> 'record'").groupBy("file").applyInPandas(join, "file string, block long, seq long, raw string")
    return found.where("kind = 'record'").drop("kind").unionByName(edges)


def judge(fields: dict[str, str] | None, mapping: list[tuple]) -> tuple[str | None, dict[str, str] | None]:
    """(reason, None) of a record to drop, (None, target to value) of one to load."""
    if fields is None:
        return READ_FAILED, None
    values: dict[str, str] = {}
    for source, kind, target, required in mapping:
        raw = fields.get(source)
        if raw is None or not raw.strip():
            if required:
                return ("missing_source_column/" if raw is None else "empty_required_value/") + target, None
            continue
        got = convert(raw, kind)
        if got:
            values[target] = got
        elif required:
            return "conversion_failed/" + target, None
    return None, values


def parse_records(records: DataFrame, mappings: DataFrame, guarded: bool = False) -> DataFrame:
    """records(record_id, dataset, fmt, batch, raw) to (record_id, dataset, batch, reason, fields map<string,string>).

    ``reason`` is null for records that load; ``fields`` is null for the others. With guarded, mappings with unknown or renamed targets
    and a data set of which nothing loads are errors.
    """
    rows = mappings.select("dataset", "fmt", "pos", "source_field", "source_type", "target_field", "required").limit(MOST_MAPPINGS + 1).collect()
    if len(rows) > MOST_MAPPINGS:
        raise ValueError(f"more than {MOST_MAPPINGS} mapping rows")
    known: dict[tuple[str, str], list[tuple]] = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        known.setdefault((r["dataset"], r["fmt"]), []).append((r["source_field"], r["source_type"], r["target_field"], bool(r["required"])))
    if guarded and (faults := mapping_faults([r.asDict() for r in rows])):
        raise ValueError("; ".join(faults))

    def parse(batches):
        for g in batches:
            keys = list(zip(g["dataset"], g["fmt"]))
            raws = [r if isinstance(r, str) else None for r in g["raw"]]
            fields: list[dict[str, str] | None] = [None] * len(g)
            csv = [i for i, (_, fmt) in enumerate(keys) if fmt == "csv"]
            for i, cells in zip(csv, _csv_fields([raws[i] for i in csv])):
                m = known.get(keys[i], [])
                if cells is not None and m and len(cells) == len(m):
                    fields[i] = {x[0]: c for x, c in zip(m, cells)}
            for i, (_, fmt) in enumerate(keys):
                if fmt == "jsonl":
                    fields[i] = json_fields(raws[i])
            judged = [judge(f, known.get(k, [])) for f, k in zip(fields, keys)]
            yield pd.DataFrame({"record_id": pd.array([None if x is None or x != x else int(x) for x in g["record_id"]], dtype="Int64"), "dataset": g["dataset"], "batch": g["batch"], "reason": [j[0] for j in judged], "fields": [j[1] for j in judged]})

    out = records.select("record_id", "dataset", "fmt", "batch", "raw").mapInPandas(parse, "record_id long, dataset string, batch string, reason string, fields map<string,string>")
    if guarded:
        out = materialize(out, "parsed")
        for r in out.groupBy("dataset").agg(F.count_if(F.col("reason").isNull()).alias("loaded")).where("loaded = 0").limit(1).collect():
            raise ValueError(f"all records of {r['dataset']} were dropped")
    return out


def preprocess_report(parsed: DataFrame) -> DataFrame:
    """Counts of each batch: total, processed and dropped records and the drops by reason."""
    per = parsed.groupBy("dataset", "batch", "reason").agg(F.count("*").alias("n"))
    return per.groupBy("dataset", "batch").agg(
        F.sum("n").alias("total_records"),
        F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("processed_records"),
        F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("dropped_records"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("drops"),
    )
