"""Queries of the problems on text for language models, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import leaks as _leaks
from pressmill.llm import languages, near_duplicates, packing, quality, site_lines, splitting, vector_search
from pressmill.session import table

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", F.col("metadata.source_name").alias("source"), "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.covered_lines(_sourced(spark, d)).select("id", F.col("line_no").cast("long").alias("line_no"))


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """For each length up to eight lines: how many blocks of that many lines each source repeats, and in how many places."""
    return site_lines.count_blocks(_sourced(spark, d))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(_sourced(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, d, "articles").select("id", "title", "content"), width=3, similarity=0.6)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """With the usual five words and a similarity of 0.8."""
    return near_duplicates.groups(table(spark, d, "articles").select("id", "title", "content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "articles")).where("piece = 0").select("id", "boundary")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "articles"), with_text=True)


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces put together again: all within the limit and overlapping by 200, they give back the trimmed text."""
    return splitting.rejoined(p4_pieces(spark, d)).select("id", "within", "overlapping", F.md5("text").alias("text"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", F.col("language").alias("label"), "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _labelled(spark, d)
    return languages.mislabelled_lines(docs, languages.train(docs))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _labelled(spark, d)
    return languages.language_of_documents(languages.language_of_lines(docs, languages.train(docs)), docs)


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every passage in one language within a line, with its place and confidence."""
    docs = _labelled(spark, d)
    return languages.language_of_segments(docs, languages.train(docs)).distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_embeddings").select("id", F.col("model_name").alias("model"), "embedding")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.similar_pairs(_vectors(spark, d))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors, however similar, of every vector whose hashed id is divisible by 50."""
    return vector_search.neighbours(_vectors(spark, d), queries="pmod(xxhash64(id), 50) = 0")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", packing.byte_tokens().alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_items(packing.pack(_sizes(spark, d)))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of each document its placed tokens and pieces."""
    return packing.pack(_sizes(spark, d)).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """No container is too full, no token is lost, and nine tenths of the room are used at least."""
    return packing.summary(packing.pack(_sizes(spark, d))).select("over", "tokens", (F.col("used") >= 0.9).alias("well_used"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(_sizes(spark, d)))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return _leaks.leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each leaked item: in how many documents, and the longest passage in words."""
    return _leaked(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("words").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.lacking_prose(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"))


def p10_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Of each text its words, their mean length, and the shares of digits and of symbols, to six digits."""
    r6 = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return quality.text_quality(table(spark, d, "documents")).select("doc_id", "words", r6("mean_word_length"), r6("digit_ratio"), r6("symbol_ratio"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_LINES = r"""
WITH a AS (SELECT DISTINCT id, lower(trim(metadata.source_name)) AS s, content FROM articles WHERE trim(metadata.source_name) <> '' AND content IS NOT NULL),
l AS (SELECT id, s, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM a),
k AS (SELECT id, s, line_no, lower(regexp_replace(line, '\P{L}+', '', 'g')) AS k FROM l),
f AS (SELECT s, k FROM k WHERE k <> '' GROUP BY s, k HAVING count(DISTINCT id) >= 5)
"""


def _longest(text: str, separator: str) -> str:
    """SQL for the largest trimmed length of the parts of a text."""
    return f"list_max(list_transform(regexp_split_to_array({text}, '{separator}'), lambda x: length(regexp_replace(x, '^{WHITE}+|{WHITE}+$', '', 'g'))))"


# The longest shared passage of each leaked item: common runs of twelve words at one distance of places (an island each) joined up.
_ITEMS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM bench_items WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
y AS (SELECT item_id, j, array_to_string(w[j:j + 11], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS j)),
h AS (SELECT doc_id, item_id, i, i - j AS apart FROM x JOIN y USING (g)),
r AS (SELECT doc_id, item_id, apart, i, i - row_number() OVER (PARTITION BY doc_id, item_id, apart ORDER BY i) AS island FROM h),
s AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, apart, island)
SELECT item_id, count(DISTINCT doc_id) AS docs, max(words) AS longest FROM s GROUP BY item_id"""
# Classes of equal sets of five consecutive words, and to how many documents of other sets they are similar by 0.8.
_GROUPS = r"""
WITH a AS (SELECT id, max(coalesce(title, '')) || ' ' || max(content) AS t FROM articles WHERE trim(content, chr(9) || chr(10) || chr(13) || ' ') <> '' GROUP BY id),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM a),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
c AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS cls FROM s GROUP BY id),
p AS (SELECT x.id AS one, y.id AS two, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.id <> y.id GROUP BY ALL),
l AS (SELECT one, count(*) AS links FROM p JOIN c a ON a.id = one JOIN c b ON b.id = two WHERE a.cls <> b.cls AND shared >= 0.8e0 * (a.n + b.n - shared) GROUP BY one),
e AS (SELECT DISTINCT id FROM articles WHERE id IS NOT NULL),
k AS (SELECT id, CASE WHEN cls IS NOT NULL THEN 'set ' || cls WHEN len(w) > 0 THEN 'words ' || array_to_string(w, ' ') ELSE 'id ' || id END AS cls FROM e LEFT JOIN c USING (id) LEFT JOIN w USING (id))
SELECT id, min(id) OVER (PARTITION BY cls) AS class_id, count(*) OVER (PARTITION BY cls) AS copies, coalesce(links, 0) AS links FROM k LEFT JOIN l ON one = id"""


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    grams = "SELECT {0}, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS g FROM (SELECT {0}, {1} AS w FROM {2}), LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)"
    return {
        "p1_found": _LINES + "SELECT id, line_no FROM k JOIN f USING (s, k)",
        "p1_blocks": _LINES
        + """, w AS (SELECT id, s, list(nullif(k, '') ORDER BY line_no) AS w FROM k GROUP BY id, s),
b AS (SELECT id, s, m AS length, w[i:i + m - 1] AS block FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), LATERAL (SELECT unnest(range(1, 9)) AS m) WHERE i + m - 1 <= len(w)),
g AS (SELECT s, length, block, count(*) AS n FROM b WHERE len(list_filter(block, lambda x: x IS NULL)) = 0 GROUP BY ALL HAVING count(DISTINCT id) >= 5)
SELECT s AS source, length::INT AS length, count(*) AS blocks, sum(n)::BIGINT AS places FROM g GROUP BY ALL""",
        "p1_cleaned": _LINES
        + """, g AS (SELECT k.id, k.line_no, k.line, f.k IS NOT NULL AS gone FROM (SELECT k.*, l.line FROM k JOIN l USING (id, s, line_no)) k LEFT JOIN f USING (s, k)),
c AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS content, count(*) FILTER (gone) AS removed FROM g GROUP BY id)
SELECT a.id, CASE WHEN c.id IS NULL OR removed = 0 THEN a.content ELSE c.content END AS content, coalesce(removed, 0)::INT AS removed
FROM (SELECT DISTINCT id, content FROM articles) a LEFT JOIN c USING (id)""",
        "p4_found": f"""
SELECT id, CASE WHEN {_longest("content", "\\n" + WHITE + "*\\n")} <= 4000 THEN 'paragraph'
WHEN {_longest("content", "\\n")} <= 4000 THEN 'line'
WHEN {_longest("regexp_replace(content, '([.!?…])" + WHITE + "', '\\1' || chr(1), 'g')", chr(1))} <= 4000 THEN 'sentence'
WHEN {_longest("content", WHITE + "+")} <= 4000 THEN 'word' ELSE 'none' END AS boundary
FROM (SELECT DISTINCT id, content FROM articles WHERE length(content) > 4000)""",
        "p3_found": r"""
WITH a AS (SELECT id, max(coalesce(title, '')) || ' ' || max(content) AS t FROM articles WHERE trim(content, chr(9) || chr(10) || chr(13) || ' ') <> '' GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM a),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.id < y.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE c >= 0.6e0 * (na.n + nb.n - c)""",
        "p6_found": """
WITH v AS (SELECT id, any_value(model_name) AS m, any_value(embedding)::DOUBLE[] AS e FROM article_embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS c FROM v x JOIN v y ON x.m = y.m AND x.id <> y.id),
r AS (SELECT a, b, c FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE c >= 0.9e0""",
        "p4_rejoined": f"SELECT DISTINCT id, true AS within, true AS overlapping, md5(regexp_replace(content, '^{WHITE}+|{WHITE}+$', '', 'g')) AS text FROM articles WHERE length(content) > 4000",
        "p8_documents": "SELECT doc_id, strlen(text) + 1 AS tokens, ceil((strlen(text) + 1) / 4096e0)::BIGINT AS pieces FROM documents WHERE text IS NOT NULL",
        "p8_summary": "SELECT 0::BIGINT AS over, sum(strlen(text) + 1)::BIGINT AS tokens, true AS well_used FROM documents WHERE text IS NOT NULL",
        "p9_items": _ITEMS,
        "p10_ratios": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, length(regexp_replace(text, '{WHITE}+', '', 'g')) AS n, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS d FROM documents),
l AS (SELECT *, len(w) AS words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars FROM t)
SELECT doc_id, coalesce(words, 0) AS words, CASE WHEN words > 0 THEN floor(chars / words * 1e6 + 0.5e0) / 1e6 END AS mean_word_length,
CASE WHEN n > 0 THEN floor(d / n::DOUBLE * 1e6 + 0.5e0) / 1e6 END AS digit_ratio, CASE WHEN n > 0 THEN floor((n - chars) / n * 1e6 + 0.5e0) / 1e6 END AS symbol_ratio FROM l""",
        "p3_groups": _GROUPS,
        "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096",
        "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({grams.format('doc_id', words, 'documents')}) JOIN ({grams.format('item_id', words, 'bench_items')}) USING (g)",
    }
