import random
from collections import defaultdict

import numpy as np

from pressmill.llm import packing, site_lines, splitting

ARTICLE = "id string, source string, content string, src string, gone string, cls string"


def key(line):
    return "".join(c for c in line if c.isalpha()).lower()


def covered(rows, min_docs, size):
    """Every line in a run of ``size`` lines that at least min_docs documents of the source have."""
    docs = {(i, s.strip().lower()): c.split("\n") for i, s, c in rows if s and s.strip() and c is not None}
    where = defaultdict(set)
    for (i, s), lines in docs.items():
        for k in range(len(lines) - size + 1):
            run = tuple(map(key, lines[k : k + size]))
            if all(run):
                where[s, run].add((i, k))
    return {(i, k + j) for at in where.values() if len({i for i, _ in at}) >= min_docs for i, k in at for j in range(size)}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        lines = [rng.choice(["Share this!", "share THIS", "By us", "© 2019 x", "© 2020 X.", "", "123", f"body {rng.choice('abcdefgh') * 3}", "Čitaj još"]) for _ in range(rng.randint(0, 9))]
        rows.append((f"{i:02}", rng.choice(["One", " one ", "ONE", "two", None, " "]), "\n".join(lines)))
    rows += [rows[0], rows[1], ("zz", "one", None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ARTICLE)
    for size in (1, 2, 3):
        got = {tuple(r) for r in site_lines.covered_lines(df, 3, size).collect()}
        assert got == covered(rows, 3, size), size
    gone = covered(rows, 3, 1)
    clean = {r["id"]: r for r in site_lines.without_repeated_lines(df, 3).collect()}
    for i, _, c in rows:
        assert clean[i]["content"] == (None if c is None else "\n".join(x for k, x in enumerate(c.split("\n")) if (i, k) not in gone))
    assert site_lines.covered_lines(df.limit(0)).count() == 0


def test_blocks_across_parts(spark, monkeypatch):
    """Parts of a few places each: most blocks begin in one part and end in another; a third of the documents are copies."""
    monkeypatch.setattr(site_lines, "PART", 25)
    rng = random.Random(5)
    rows = [(f"{i:03}", "s" if i % 3 else "t", "a\nb\nc\nd\ne\nf\ng" if i % 3 == 1 else "\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, source string, content string")
    for size in (1, 2, 5):
        assert {tuple(r) for r in site_lines.covered_lines(df, 4, size).collect()} == covered(rows, 4, size), size
    want = defaultdict(lambda: defaultdict(set))
    for i, s, c in rows:
        lines = c.split("\n")
        for m in range(1, 9):
            for k in range(len(lines) - m + 1):
                want[s, m][tuple(lines[k : k + m])].add((i, k))
    often = {k: [at for at in b.values() if len({i for i, _ in at}) >= 4] for k, b in want.items()}
    got = {(r["source"], r["length"]): (r["blocks"], r["places"]) for r in site_lines.count_blocks(df, 4).collect()}
    assert got == {k: (len(b), sum(map(len, b))) for k, b in often.items() if b}


def test_suffix_array(spark):
    rows = [("1", "s", "b\na\nb\na"), ("2", "s", "a\nb\n\nb"), ("3", "t", "a")]
    seq = site_lines.line_sequences(spark.createDataFrame(rows, "id string, source string, content string"))
    order = site_lines.suffix_array(seq, 3).toPandas()
    keys = [order[f"k{j}"].astype("Int64") for j in range(3)]
    valid = [k.notna().to_numpy() for k in keys]
    size, common = site_lines.prefixes(order["src"].to_numpy(), [k.fillna(0).to_numpy("int64") for k in keys], valid)
    docs = {r["doc"]: r["lines"] for r in seq.collect()}

    def suffix(k):
        at = int(order["line_no"][k])
        rest = docs[order["doc"][k]][at : at + 3]
        return rest[: rest.index(None)] if None in rest else rest

    assert len(order) == 8 and size.tolist() == [len(suffix(k)) for k in range(8)]
    for k in range(1, 8):
        a, b = suffix(k - 1), suffix(k)
        same = 0 if order["src"][k - 1] != order["src"][k] else next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == same and (order["src"][k - 1] != order["src"][k] or a <= b)


def greedy_kind(text, limit):
    import re

    parts = {"paragraph": re.split(r"\n\s*\n", text), "line": text.split("\n"), "sentence": re.split(r"(?<=[.!?…])\s+", text), "word": text.split()}
    return next((k for k, p in parts.items() if max((len(x.strip()) for x in p), default=0) <= limit), "none")


def test_pieces():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c. ", " ", "\n", "\n\n", "d! ", "long" * rng.randint(1, 6)]) for _ in range(rng.randint(0, 80))) for _ in range(300)] + [" \n ", "x" * 95, "a" * 41 + " b"]
    limit, overlap = 40, 6
    who, piece, begin, length, kind = splitting.cut(texts, limit, overlap)
    by = defaultdict(list)
    for w, p, b, n, k in zip(who, piece, begin, length, kind):
        by[int(w)].append((int(p), int(b), int(n), splitting.KINDS[k]))
    for i, t in enumerate(texts):
        pieces = sorted(by[i])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert {p[3] for p in pieces} == {greedy_kind(t, limit)}, repr(t)
        assert all(n <= limit for _, _, n, _ in pieces)
        for (_, b, n, _), (_, c, m, _) in zip(pieces, pieces[1:]):
            assert c == max(b + n - overlap, pieces[0][1]) and c + m > b + n
        seen = "".join(t[max(c, b + n) : c + m] for (_, b, n, _), (_, c, m, _) in zip([(0, 0, 0, "")] + pieces, pieces))
        assert "".join(seen.split()) == "".join(t.split())
        # greedy: no boundary of the kind farther on would still have fitted
        if pieces and pieces[0][3] == "word":
            _, b, n, _ = pieces[0]
            rest = t[b + n :]
            if rest.strip():
                nxt = rest.split()[0]
                assert t.index(nxt, b + n) + len(nxt) - b > limit


def test_split_edges(spark):
    df = spark.createDataFrame([("a", "x " * 3000, 1), ("a", "x " * 3000, 1), ("b", None, 1), ("c", "short", 1), ("d", " " * 5000, 1), ("e", "é" * 4001, 1), ("f", "é" * 4000, 1)], "id string, content string, piece int")
    got = splitting.split_texts(df)
    assert {(r["id"], r["boundary"]) for r in got.collect()} == {("a", "word"), ("d", "paragraph"), ("e", "none")}
    whole = splitting.split_texts(df, with_text=True)
    text = {(r["id"], r["piece"]): r["text"] for r in whole.collect()}
    assert {tuple(r) for r in splitting.rejoined(whole).collect()} == {("a", True, True, ("x " * 3000).strip()), ("d", True, True, ""), ("e", True, True, "é" * 4001)}
    assert len(text["a", 0]) <= 4000 and text["a", 0][-200:] == text["a", 1][:200]
    assert splitting.split_texts(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 400) for _ in range(3000)]
    for items, least in ((sorted(sizes, reverse=True), 0.95), ([rng.randint(1, 400) for _ in range(20_000)], 0.96)):
        fill = defaultdict(int)
        for s, b in zip(items, packing.place(np.array(items), 400)):
            fill[b] += s
        assert max(fill.values()) <= 400 and sum(items) / (400 * len(fill)) > least
    rows = [(i, s) for i, s in enumerate(sizes)] + [(3000, 1000), (3001, 800), (3002, None), (5, sizes[5])]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens int"), 400, 700)
    total, pieces = defaultdict(int), defaultdict(int)
    for r in placed.collect():
        total[r["doc_id"]] += r["tokens"]
        pieces[r["doc_id"]] += 1
    assert dict(total) == {**dict(enumerate(sizes)), 3000: 1000, 3001: 800} and pieces[3000] == 3 and pieces[3001] == 2 and {pieces[i] for i in range(3000)} == {1}
    c = packing.containers(placed, 400).collect()
    assert all(0 <= r["unused"] < 400 for r in c)
    assert {r["doc_id"] for r in placed.where("split").collect()} == {3000, 3001} == {r[0] for r in packing.cut_items(placed).collect()}
    s = packing.summary(placed, 400).first()
    assert s["containers"] == len(c) and s["over"] == 0 and s["tokens"] == sum(sizes) + 1800 and s["used"] > 0.85
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int")).count() == 0
