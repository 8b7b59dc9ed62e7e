from datetime import UTC, datetime

import itertools
import random

import numpy as np
import pytest

from pressmill.operators import timestamps as T


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2018-01-25T00:58:59.858085930Z", us(2018, 1, 25, 0, 58, 59) + 858_085),
        (" 1455582984260 ", 1_455_582_984_260_000), ("1504243736", 1_504_243_736_000_000),
        ("20231201", us(2023, 11, 30, 23)), ("Thu, 13 Apr 2023 12:47:05 +0200", us(2023, 4, 13, 10, 47, 5)),
        ("2021-12-18 14:30:44 EST", us(2021, 12, 18, 19, 30, 44)), ("March 26, 2023 2:42 AM", us(2023, 3, 26, 1, 42)),
        ("18. април 2022. 08:43", us(2022, 4, 18, 6, 43)), ("27 novembre 2022 à 12:26", us(2022, 11, 27, 11, 26)),
        ("18 de marzo de 2019, 10:12", us(2019, 3, 18, 9, 12)), ("9. April 2020, 15:05 Uhr", us(2020, 4, 9, 13, 5)),
        ("2018-10-25T06:56:42-04:00[America/New_York]", us(2018, 10, 25, 10, 56, 42)),
        ("2021-10-31 02:30:00", us(2021, 10, 31, 0, 30)), ("2021-03-28 02:30:00", us(2021, 3, 28, 1, 30)), ("2023-10-19", us(2023, 10, 18, 22)),
        ("", None), ("-", None), ("n/a", None), (None, None), ("yesterday, 14:09", None), ("2018-04-07 25:61:00", None), ("2019-02-30 10:03:00", None),
        ("0000-00-00 00:00:00", None), ("0001-01-01T00:00:00Z", None), ("2021-13-07 08:15:00", None), ("5", None), ("May 5, 2020 13:10 PM", None),
    ],
)
def test_single_readings(value, expected):
    assert T.interpretations(value, "Europe/Berlin")[:2] == [expected, expected]


def test_order_and_zone():
    assert T.interpretations("03/04/2020 10:00", "UTC")[:2] == [us(2020, 4, 3, 10), us(2020, 3, 4, 10)]
    assert T.interpretations("25/04/2020 10:00", "UTC")[1] is None
    assert T.interpretations("2020-04-25 10:00", None) == [None] * 4
    assert T.interpretations("2020-04-25 10:00 GMT", None)[0] == us(2020, 4, 25, 10)


def test_other_readings():
    """The later of a repeated hour, the other zone of an abbreviation, the finer unit of a count."""
    assert T.interpretations("2021-10-31 02:30:00", "Europe/Berlin")[::2] == [us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30)]
    assert T.interpretations("2021-12-18 14:30 IST", None)[::2] == [us(2021, 12, 18, 9), us(2021, 12, 18, 12, 30)]
    assert T.interpretations("1504243736", None)[::2] == [1_504_243_736_000_000, 1_504_243_736_000]


def sequence(rng, n):
    """Readings of n records: instants as doubles with NaN, own costs, and which are linked."""
    t = np.cumsum([[rng.uniform(-1, 2) * T.YEAR / 8] * 4 for _ in range(n)], 0) + np.array([[rng.choice([0, 0, rng.uniform(-1, 1) * T.YEAR]) for _ in range(4)] for _ in range(n)])
    t[np.array([[rng.random() < 0.1 for _ in range(4)] for _ in range(n)])] = np.nan
    cost = np.array([[rng.choice([0.0, 0.0, 1.0, 3.0]) + rng.random() / 1e6 for _ in range(4)] for _ in range(n)])
    return t, cost, np.array([k > 0 and rng.random() < 0.9 for k in range(n)])


def cost_of(t, cost, linked, states):
    steps = sum(T.transitions(t[k - 1], t[k], linked[k])[states[k - 1], states[k]] for k in range(1, len(t)))
    return sum(c[s] for c, s in zip(cost, states)) + steps


def test_lanes_equal_brute_force():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 6):
        for _ in range(5):
            t, cost, linked = sequence(rng, n)
            best = min(cost_of(t, cost, linked, s) for s in itertools.product(range(4), repeat=n))
            lanes = T.Lanes(t, cost, linked)
            assert cost_of(t, cost, linked, lanes.states()) == pytest.approx(best) and lanes.product().min() == pytest.approx(best)


def test_lanes_equal_one_pass():
    t, cost, linked = sequence(random.Random(2), 500)
    forward, came = cost[0].copy(), []
    for k in range(1, len(t)):
        options = forward[:, None] + T.transitions(t[k - 1], t[k], linked[k])
        came.append(options.argmin(0))
        forward = options.min(0) + cost[k]
    assert cost_of(t, cost, linked, T.Lanes(t, cost, linked).states()) == pytest.approx(forward.min())


def test_parts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows, sources = [], []
    for s in range(6):
        order = rng.choice(["dmy", "mdy"])
        for i in range(8):
            d, m = rng.randint(1, 28), rng.randint(1, 12)
            text = f"{d:02}/{m:02}/2020 10:00" if order == "dmy" else f"{m:02}/{d:02}/2020 10:00"
            rows.append((f"{s}-{i}", text, f"  Source {s}" if i % 2 else f"SOURCE {s} ", datetime(2021, 1, 1, 0, i)))
        sources.append((f"source {s}", "UTC", order))
    rows.append(("alone", "05/04/2020 10:00", None, datetime(2021, 1, 1)))
    df = spark.createDataFrame(rows, "id string, value string, source string, at timestamp")
    known = spark.createDataFrame(sources, "source string, home_zone string, date_order string")
    got = {r[0]: r[1] for r in T.resolve_instants(df, known, False).collect()}
    monkeypatch.setattr(T, "PART", 4)  # sources are cut into several parts then
    assert {r[0]: r[1] for r in T.resolve_instants(df, known, False).collect()} == got
    for s in range(6):
        seq = [r for r in rows if r[0].startswith(f"{s}-")]
        readings = [T.interpretations(r[1], "UTC") for r in seq]
        ok = np.array([[x is not None for x in r] for r in readings])
        values = np.array([[x or 0 for x in r] for r in readings])
        t, linked = np.where(ok, values, np.nan), np.arange(len(seq)) > 0
        cost = T.emissions(values, ok, np.full(len(seq), -1))
        best = min(cost_of(t, cost, linked, x) for x in itertools.product((0, 1), repeat=len(seq)))
        least = min(cost_of(t, cost, linked, x) for x in itertools.product(*[[k for k in (0, 1) if r[k] == got[q[0]]] for r, q in zip(readings, seq)]))
        assert least == pytest.approx(best)
    declared = {r[0]: r[1] for r in T.resolve_instants(df, known).collect()}
    for s, (_, _, order) in enumerate(sources):
        for r in (r for r in rows if r[0].startswith(f"{s}-")):
            assert declared[r[0]] == T.interpretations(r[1], "UTC")[order == "mdy"]


def test_edges(spark):
    schema = "id string, value string, source string, at timestamp, src string, us0 long"
    rows = [
        ("a", "2020-01-01 00:00:00", None, None, "x", 1), ("b", "2020-01-01T00:00:00Z", None, None, "x", 1), ("b", "2020-01-01T00:00:00Z", None, None, "x", 1),
        ("c", None, "s", None, "x", 1), ("d", "31/12/2020 01:00", "s", None, "x", 1), ("e", "12/31/2020 01:00", "S ", None, "x", 1), ("f", "2020-01-01", "unknown", None, "x", 1),
    ]
    known = spark.createDataFrame([("s", "UTC", "mdy"), (None, None, None)], "source string, home_zone string, date_order string")
    got = sorted(map(tuple, T.resolve_instants(spark.createDataFrame(rows, schema), known).collect()))
    assert got == [("b", us(2020, 1, 1)), ("e", us(2020, 12, 31, 1))]
    assert T.resolve_instants(spark.createDataFrame([], schema), known).count() == 0
