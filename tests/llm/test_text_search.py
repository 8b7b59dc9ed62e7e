import random
import re

import numpy as np
import pytest

from pressmill.llm import languages, leaks, near_duplicates, quality, vector_search
from pressmill.llm.text_arrays import chunks, grams, words

WORD = re.compile(r"[^\W_]+")


def test_words():
    texts = ["Ab, cd_ef 12", None, "", "ČA čа ß", "x" * 3]
    w = words(texts)
    got = [[] for _ in texts]
    for t, s, e in zip(w.text, w.start, w.end):
        got[t].append("".join(map(chr, w.codes[s:e])))
    assert got == [WORD.findall((t or "").lower()) for t in texts]
    assert len(set(words(["ab ba ab", "ab"]).hash)) == 2
    h, at = grams(words(["a b c", "a b"]), 2)
    assert len(h) == 3 and h[0] == h[2]
    assert list(chunks([])) == []


def shared_runs(a, b, n):
    x, y = WORD.findall((a or "").lower()), WORD.findall((b or "").lower())
    return bool({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} & {tuple(y[i : i + n]) for i in range(len(y) - n + 1)})


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(12)] + [(12, None), (13, "")]
    docs = []
    for i in range(60):
        t = rng.choices(vocabulary, k=rng.randint(0, 50))
        if i % 2:
            src = (rng.choice(items)[1] or "").split()
            k = rng.randint(0, max(0, len(src) - 12))
            t[5:5] = src[k : k + rng.randint(9, 15)]
        docs.append((i, ", ".join(t).upper(), "x"))
    docs += [docs[3], (99, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    q = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b) for a, t, _ in docs for b, s in items if shared_runs(t, s, 12)}
    assert want
    for most in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]): r["words"] for r in leaks.leaks(d, q, most_words=most).collect()}
        assert set(got) == want and min(got.values()) >= 12
    assert leaks.leaks(d.limit(0), q).count() == 0 and leaks.leaks(d, q.limit(0)).count() == 0


def jaccard(a, b, n):
    f = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall(t.lower())] for i in range(len(w) - n + 1)}
    x, y = f(a), f(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        rows.append((f"{i:03}a", "T", " ".join(base), 1))
        for c in "bc":
            edited = list(base)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((f"{i:03}{c}", "T" if c == "b" else None, " ".join(edited), 1))
    rows += [rows[0], ("n1", None, None, 1), ("n2", "t", " ", 1), ("s1", None, "one two", 1), ("s2", None, "one two", 1)]
    df = spark.createDataFrame(rows, "id string, title string, content string, cls int")
    text = {i: f"{t or ''} {c}" for i, t, c, _ in rows if c and c.strip()}
    ids = sorted(text)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(text[a], text[b], 3) >= 0.6}
    got = [tuple(r) for r in near_duplicates.pairs(df, 3, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    g = {r["id"]: r for r in near_duplicates.groups(df, 3, 0.6).collect()}
    assert set(g) == {r[0] for r in rows} and {g[i]["class_id"] for i in ("s1", "s2")} == {"s1"}  # short texts have no set, but equal ones are a class
    assert all(g[i]["links"] + g[i]["copies"] - 1 == sum(i in p for p in want) for i in g if i[0] != "s")
    assert near_duplicates.pairs(df.limit(0), 3, 0.6).count() == 0


def test_multi_index_guarantee():
    """Every pair of signatures within the distance shares a key."""
    rng = np.random.default_rng(1)
    c, s, e = 4, 5, 1
    a = rng.integers(0, 1000, (300, c * s), np.uint32)
    b = a.copy()
    for row in b:
        row[rng.choice(c * s, c * (e + 1) - 1, replace=False)] += 1
    x, y = near_duplicates._keys(a, c, s, e), near_duplicates._keys(b, c, s, e)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    x[200:260] = x[:60] + 0.1 * rng.standard_normal((60, 8))
    x[260:300] = x[0]
    rows = [(f"{i:03}", "m" if i % 5 else "n", [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [("x1", "m", None), ("x2", "m", [1.0]), ("x3", "m", [0.0] * 8), ("x4", "m", [float("nan")] * 8), ("x5", "m", [None] * 8), ("x6", "alone", [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:3], "id string, model string, embedding array<float>")
    want, every = set(), {}
    for m in "mn":
        own = [(i, np.array(v, np.float32).astype(float)) for i, mm, v in rows if mm == m]
        u = np.stack([v / np.linalg.norm(v) for _, v in own])
        c = np.round(u @ u.T, 12)
        for k, (i, _) in enumerate(own):
            order = sorted((j for j in range(len(own)) if j != k), key=lambda j: (-c[k, j], own[j][0]))[:5]
            every[i] = [own[j][0] for j in order]
            want |= {tuple(sorted((i, own[j][0]))) for j in order if c[k, j] >= 0.9}
    got = {tuple(r) for r in vector_search.similar_pairs(df, dim=8).collect()}
    assert got == want
    full = vector_search.neighbours(df, 5, None, 8, "id < '1'").collect()
    hit = sum(r["neighbour"] in every[r["id"]] for r in full)
    assert {r["id"] for r in full} == {f"{i:03}" for i in range(100)} and hit / len(full) >= 0.9
    assert vector_search.similar_pairs(df.limit(0), dim=8).count() == 0
    assert vector_search.chi_square(vector_search.quantile(0.9, 8), 8) == pytest.approx(0.9)
    assert vector_search.quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


TEXT = {
    "english": "the council said that it would open the new library before the summer because people had asked for it again and again",
    "german": "der ausschuss hat am montag gesagt dass die neue brücke im herbst nicht eröffnet wird weil das geld dafür noch fehlt",
    "french": "la mairie a dit ce vendredi que le nouveau pont ne serait pas ouvert avant la fin de cette année parce que tout manque",
    "spanish": "el ayuntamiento dijo este viernes que el puente nuevo no será abierto antes del verano porque todavía no hay dinero",
    "serbian": "savet je rekao u petak da novi most neće biti otvoren pre leta jer još uvek nema novca a ljudi ga traže već dugo",
}


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for lang, t in TEXT.items():
        w = t.split()
        for i in range(40):
            rng.shuffle(w)
            body = " ".join(w[:15])
            other = TEXT["german" if lang != "german" else "english"]
            rows.append((f"{lang}{i}", lang.upper() + "-XX" if i < 36 else (None if i < 38 else "spanish" if lang != "spanish" else "en"), f"{body}\n{t}\nshort line\n{other if i == 5 else body}", "q"))
    rows += [rows[0], ("n", "en", None, "q"), ("e", "en", "", "q"), ("d", "en", "1 2 3 4 5 6 7 8 9", "q")]
    df = spark.createDataFrame(rows, "id string, label string, content string, language string")
    models = languages.train(df)
    got = {(r["id"], r["line_no"]): r["true_language"] for r in languages.mislabelled_lines(df, models).collect()}
    want = {}
    for lang in TEXT:
        for i in (36, 37, 38, 39):
            want |= {(f"{lang}{i}", k): lang for k in (0, 1, 3)}
        want[f"{lang}5", 3] = "german" if lang != "german" else "english"
    assert got == want
    docs = {r["id"]: r for r in languages.language_of_documents(languages.language_of_lines(df, models), df).collect()}
    assert docs["serbian37"]["language"] == "serbian" and 0.5 <= docs["serbian37"]["confidence"] <= 1 and all((docs[i]["language"], docs[i]["confidence"]) == (None, 0.0) for i in "den")
    mixed = f"{TEXT['english'].capitalize()}. {TEXT['english'].capitalize()}! {TEXT['german'].capitalize()}.\n{TEXT['french']}"
    segments = languages.language_of_segments(spark.createDataFrame([("x", mixed), ("y", None), ("z", "")], "id string, content string"), models).orderBy("begin").collect()
    assert [(r["line_no"], r["language"], mixed[r["begin"] : r["begin"] + r["length"]].split()[0].lower(), r["words"]) for r in segments] == [
        (0, "english", "the", 2 * len(TEXT["english"].split())), (0, "german", "der", len(TEXT["german"].split())), (1, "french", "la", len(TEXT["french"].split())),
    ]
    assert all(0.5 <= r["confidence"] <= 1 for r in segments)
    assert languages.train(df.limit(0)) is None and languages.mislabelled_lines(df, None).count() == 0


def test_kneser_ney_sums_to_one():
    texts = ["abba baab abab", "aab"]
    w = words(texts)
    u, at = np.unique(w.hash, return_index=True)
    t = languages.letters(w, at)
    m = languages.CharacterModel(t, np.ones(len(u)))
    # after "a" at a word's start: a, b or the end, and the floor for the rest
    p = sum(2 ** -m.bits(languages.letters(q, np.arange(1)), 1)[0] for q in (words([c]) for c in ("a",)))
    assert 0 < p < 1 and all((v >= 0).all() and (v <= 1).all() for v in [*m.values, *m.backoff])
    for g, v, c, b in zip(m.grams, m.values, m.contexts, m.backoff):
        assert (np.diff(g.astype(object)) > 0).all() and len(c) == len(b) and len(g) == len(v)


def test_quality(spark):
    prose = "The council said that it would not open the library before the summer, and people were surprised. It was the third time that this has been delayed for a year.\n"
    table = "Team,P,W\n" + "\n".join(f"Name{i},{i},{i * 3}" for i in range(20))
    rows = [
        (1, prose * 3, "x"), (2, table, "x"), (3, prose + "\n" + table * 2, "x"), (4, None, "x"), (5, " \n", "x"), (6, "\n".join(f"{i}. river Name{i}" for i in range(30)), "x"),
        (7, "#$%^ &*( " * 40, "x"), (8, "\n".join(prose.replace(". ", ".\n").split(", ")), "x"), (1, prose * 3, "x"), (9, prose.upper() * 2, "x"), (10, "function a(){var x=1;}\n" * 20, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    assert {r["doc_id"] for r in quality.lacking_prose(df).collect()} == {2, 3, 6, 7, 10}
    stats = {r["doc_id"]: r for r in quality.text_quality(df).collect()}
    assert len(stats) == 10 and stats[4]["prose_share"] is None and stats[5]["prose_share"] is None and stats[2]["aligned_share"] > 0.9 and stats[6]["list_share"] == 1.0
    assert stats[1]["words"] == len(WORD.findall(prose * 3)) and stats[1]["closed_lines"] == 1.0
    assert quality.lacking_prose(df.limit(0)).count() == 0


def test_quality_of_layouts():
    """By layout and sentences alone, without counts of a collection, in languages that nothing names."""
    polish = "Rada miasta ogłosiła w piątek, że nowa biblioteka zostanie otwarta dopiero po wakacjach. Mieszkańcy byli zaskoczeni, bo budowa trwała trzy lata."
    bullets = "- The council said on Friday that the library would open late.\n- Residents were surprised, because the work had taken three years.\n"
    wrapped = "\n".join(polish[k : k + 40] for k in range(0, len(polish), 40))
    rows = "\n".join(f"Judge name{k} (Town {k}.)" for k in range(9))
    code = "def f(x):\n    if x > 3:\n        return x + 1\n    return None\n\n" * 10
    items = "- milk and eggs\n- bread from the bakery\n- two bottles of water\n" * 4
    share = quality.measure([polish, bullets, wrapped, rows, code, items, "pier dock " * 50, "", None])["prose_share"]
    assert (share[:3] == 1).all() and (share[3:7] == 0).all() and (share[7:] != share[7:]).all()
    stats = quality.measure([items, rows, code])
    assert stats["list_share"][0] == 1 and stats["aligned_share"][1] == 1 and stats["indent_period"][2] > 0.5


def test_vectors_in_many_cells(spark, monkeypatch):
    """Five levels of cells, several trees, and blocks of a few vectors; a third of the vectors close to one another."""
    monkeypatch.setattr(vector_search, "CELL", 40)
    monkeypatch.setattr(vector_search, "MANY_LEVELS", 4)
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 16))
    x = np.concatenate((base, base[:150] + 0.15 * rng.standard_normal((150, 16)), base[0] + 0.1 * rng.standard_normal((350, 16)))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04}", "m", v.tolist()) for i, v in enumerate(x)], "id string, model string, embedding array<float>")
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    top = np.argsort(-c, 1, kind="stable")[:, :5]
    want = {tuple(sorted((i, int(j)))) for i in range(len(x)) for j in top[i] if c[i, j] >= 0.9}
    got = {tuple(map(int, r)) for r in vector_search.similar_pairs(df, dim=16).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) <= 1.01 * len(want)
    full = vector_search.neighbours(df, 5, None, 16, "id < '0300'").collect()
    hit = sum(int(r["neighbour"]) in top[int(r["id"])] for r in full)
    assert len(full) == 1500 and hit >= 0.97 * 1500


def test_probes():
    """The cells that are probed hold a neighbour at the radius as often as asked."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 7))
    near = x + 0.4 * rng.standard_normal(x.shape)
    point, cell = vector_search.probes(x, np.full(2000, 0.4), 0.9)
    held = np.zeros(2000, bool)
    held[point[cell == vector_search.cells(near)[point]]] = True
    assert held.mean() >= 0.88 and len(point) < 2000 * 2**7 * 0.3
    assert vector_search.tail(np.array([0.0, 1.0, 2.0])) == pytest.approx([0.5, 0.158655, 0.022750], abs=1e-5)


def test_leaks_of_several_texts(spark):
    """An id with two texts, a fingerprint that all documents share, and an item under two ids: both ways agree."""
    w = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(w[:14])), (1, " ".join(w[:30])), (2, "x " + " ".join(w[5:40]))] + [(i, " ".join(w[:20]) + f" own{i}") for i in range(3, 40)]
    items = [(7, " ".join(w)), (8, " ".join(w)), (9, "nothing in common here")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small, large = ({tuple(r) for r in leaks.leaks(d, i, most_words=n).collect()} for n in (10**6, 1))
    assert small == large and {(1, 7, 30), (1, 8, 30), (2, 7, 35), (3, 8, 20)} <= small and len(small) == 2 * 39


def test_colliding_keys(spark):
    """Runs of every length, across batches, with copies of a key beyond the bound for one block."""
    import random

    rng = random.Random(4)
    rows = [(k, rng.randint(0, 400), 10 + rng.randint(0, 3)) for k in range(60) for _ in range(rng.choice([1, 2, 3, 9, 60]))] + [(1000, c, 10) for c in range(150)]
    size = {}
    rows = list({(k, c, size.setdefault(c, n)) for k, c, n in rows})
    by = {}
    for k, c, n in rows:
        by.setdefault(k, []).append(c)
    want = {tuple(sorted((x, y))) for cs in by.values() for x in cs for y in cs if x != y and min(size[x], size[y]) >= 0.8 * max(size[x], size[y])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for hot in (7, 40, 1000):
            got = near_duplicates.colliding(spark.createDataFrame(rows, "key long, cls long, n int"), 0.8, hot)
            assert {tuple(r) for r in got.distinct().collect()} == want, hot
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert near_duplicates.colliding(spark.createDataFrame([], "key long, cls long, n int"), 0.8).count() == 0
