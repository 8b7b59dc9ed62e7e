"""Null ids, very long texts and a group of copies that is a third of all rows."""

from pressmill.llm import languages, leaks, near_duplicates, packing, quality, site_lines, splitting, vector_search

PROSE = "The council said that it would not open the library before the summer, and people were surprised that it was delayed. "


def test_null_ids_and_long_texts(spark):
    long = PROSE * 20_000  # over two million characters
    rows = [("a", "s", "t", "en", long), (None, "s", "t", "en", PROSE * 50), ("b", None, None, None, None), ("c", "s", "t", "en", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "id string, source string, title string, label string, content string")
    assert {r["id"] for r in splitting.split_texts(df).where("piece = 0").collect()} == {"a", "c"}
    last = splitting.split_texts(df).where("id = 'a'").orderBy("piece").collect()
    assert last[-1]["begin"] + last[-1]["length"] == len(long.rstrip()) and max(r["length"] for r in last) <= 4000
    assert site_lines.covered_lines(df, 1).where("id IS NULL").count() == 0
    assert {r["id"] for r in site_lines.without_repeated_lines(df).collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in near_duplicates.groups(df, 3, 0.6).collect()} == {(i, i, 1, 0) for i in "abc"}  # one with a set, one null, one of two words
    models = languages.train(df)
    assert {r["id"] for r in languages.language_of_lines(df, models).collect()} == {"a", "c"}
    d = spark.createDataFrame([(1, long), (None, PROSE), (2, None), (3, "x" * 1_000_000)], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.text_quality(d).collect()} == {1, 2, 3} and [r[0] for r in quality.lacking_prose(d).collect()] == [3]
    items = spark.createDataFrame([(7, PROSE), (None, PROSE)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, items).collect()] == [(1, 7)]
    placed = packing.pack(d.select("doc_id", packing.byte_tokens().alias("tokens")))
    assert {r["doc_id"] for r in placed.collect()} == {1, 3}


def test_short_texts_are_classes(spark):
    rows = [("1", None, "Two words"), ("2", "two", "words!"), ("3", None, "words two"), ("4", None, "..."), ("5", None, " "), ("6", "two words", None)]
    got = near_duplicates.groups(spark.createDataFrame(rows, "id string, title string, content string"))
    assert {tuple(r) for r in got.collect()} == {("1", "1", 2, 0), ("2", "1", 2, 0), *((i, i, 1, 0) for i in "3456")}


def test_a_third_are_copies(spark):
    rows = [(f"c{i:04}", "T", PROSE * 3, [1.0, 2.0, 3.0, 4.0], "m") for i in range(500)] + [(f"o{i:04}", str(i), " ".join(f"w{i}x{j}" for j in range(30)), [float(i), 1.0, -float(i), 2.0], "m") for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, title string, content string, embedding array<float>, model string")
    g = near_duplicates.groups(df)
    assert g.where("copies = 500 AND class_id = 'c0000' AND links = 0").count() == 500 and g.count() == 1500
    n = vector_search.neighbours(df.select("id", "model", "embedding"), 5, 0.9, 4)
    mine = {r["neighbour"] for r in n.where("id = 'c0499'").collect()}
    assert mine == {f"c{i:04}" for i in range(5)} and {r["neighbour"] for r in n.where("id = 'c0001'").collect()} == {f"c{i:04}" for i in (0, 2, 3, 4, 5)}


def test_copies_of_random_words_are_not_prose(spark):
    odd = " ".join(reversed(PROSE.replace(",", "").replace(". ", "").split())) + "."
    rows = [(i, f"Name{i} came. {PROSE}Then Place{i} followed.") for i in range(400)] + [(1000 + i, odd if i % 2 else odd.upper() + "\n") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in quality.lacking_prose(df).collect()} == {i for i, _ in rows if i >= 1000}
    assert quality.lacking_prose(spark.createDataFrame([(1, PROSE * 3), (2, PROSE * 3)], df.schema)).count() == 0


def test_a_rare_script_is_modelled(spark):
    latin = "savet je rekao u petak da novi most neće biti otvoren pre leta jer još uvek nema novca a ljudi ga traže već dugo".split()
    cyrillic = "савет је рекао у петак да нови мост неће бити отворен пре лета јер још увек нема новца а људи га траже већ дуго".split()
    english = PROSE.lower().replace(",", "").replace(".", "").split()
    turned = lambda w, i: " ".join(w[i % len(w) :] + w[: i % len(w)]) + "\n" + " ".join(w[(i * 7) % len(w) :] + w[: (i * 5) % len(w)])
    rows = [(f"l{i}", "sr", turned(latin, i) + "\n" + turned(latin, i + 3)) for i in range(24)] + [(f"e{i}", "en", turned(english, i)) for i in range(20)]
    rows += [(f"k{i:03}", "sr", "\n".join(turned(latin, j) for j in range(20))) for i in range(100)]
    rows += [(f"c{i}", "sr", turned(cyrillic, i)) for i in range(8)] + [(f"w{i}", "en", turned(cyrillic, i + 10)) for i in range(3)] + [("m", "sr", turned(english, 2))]
    df = spark.createDataFrame(rows, "id string, label string, content string")
    models = languages.train(df)
    kinds = [models.languages[c] for c in models.classes]
    assert sorted(kinds) == ["english", "serbian", "serbian"]
    got = {(r["id"], r["true_language"]) for r in languages.mislabelled_lines(df, models).collect()}
    assert got == {("w0", "serbian"), ("w1", "serbian"), ("w2", "serbian"), ("m", "english")}
