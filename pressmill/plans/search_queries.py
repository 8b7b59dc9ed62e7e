"""Search queries over articles and vectors, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as T
from pressmill.operators import ann as A
from pressmill.operators import embeddings
from pressmill.operators import index as I
from pressmill.operators import requests as Q
from pressmill.operators import retrieval as R
from pressmill.session import table

MODEL, DIM = "aurora-embed-64", 64
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


ONCE = "a AS (SELECT id, " + ", ".join(f"max({c}) AS {c}" for c in R.ALL_FIELDS) + " FROM articles GROUP BY id)"


def _toks(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _counted(terms: list[str], fields: tuple[str, ...], fuzz: int = 0) -> str:
    """CTEs c (id, lengths and term counts) and s (statistics)."""
    most = lambda t: (0 if len(t) < 3 else 1 if len(t) < 6 else 2) if fuzz == -1 else fuzz
    hit = lambda t: f"levenshtein(x, '{t}') <= {most(t)}" if most(t) else f"x = '{t}'"
    c = ", ".join(f"len(k_{f}) AS dl_{f}, " + ", ".join(f"len(list_filter(k_{f}, lambda x: {hit(t)})) AS tf_{f}_{i}" for i, t in enumerate(terms)) for f in fields)
    s = ", ".join(f"avg(dl_{f}) AS avg_{f}, " + ", ".join(f"count(*) FILTER (WHERE tf_{f}_{i} > 0) AS df_{f}_{i}" for i in range(len(terms))) for f in fields)
    k = ", ".join(f"{_toks(f)} AS k_{f}" for f in fields)
    return f"{ONCE}, t AS (SELECT id, {k} FROM a), c AS (SELECT id, {c} FROM t), s AS (SELECT count(*) AS n, {s} FROM c)"


def _bm25(terms: list[str], fields: tuple[str, ...], weights: dict[str, float] | None = None, best: bool = False) -> str:
    per = []
    for f in fields:
        parts = [f"ln(1e0 + (n - df_{f}_{i} + 0.5e0) / (df_{f}_{i} + 0.5e0)) * tf_{f}_{i} * 2.2e0 / (tf_{f}_{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl_{f} / avg_{f}))" for i in range(len(terms))]
        per.append(f"(0e0 + {' + '.join(parts)}) * {float((weights or {}).get(f, 1.0))!r}e0")
    total = f"greatest({', '.join(per)})" if best and len(per) > 1 else " + ".join(per)
    return f"floor(({total}) * 1e4 + 0.5e0) / 1e4"


def _where(terms: list[str], fields: tuple[str, ...], operator: str) -> str:
    return f" {operator} ".join("(" + " OR ".join(f"tf_{f}_{i} > 0" for f in fields) + ")" for i in range(len(terms)))


def _search_sql(q: R.Match, tail: str = "") -> str:
    terms = q.text.split(" ")
    return f"WITH {_counted(terms, q.fields, q.fuzziness)} SELECT id, {_bm25(terms, q.fields, q.weights, q.best_fields)} AS score FROM c, s WHERE {_where(terms, q.fields, q.operator.upper())} {tail}"


BOTH = "concat_ws(' ', title, description)"
TOP = "ORDER BY score DESC, id DESC LIMIT {}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", *R.FIELDS)


def _index(spark: SparkSession, d: str) -> I.SearchIndex:
    return I.of_table(spark, f"{d}/articles.parquet")


Q_OR, Q_AND = R.Match("council budget", R.ALL_FIELDS), R.Match("council library", R.ALL_FIELDS, "and")
Q_TITLE, Q_CONTENT = R.Match("senate restored", ("title",), "and"), R.Match("harbour strike", ("content",))
Q_BEST = R.Match("library vote", weights={"title": 3.0, "description": 2.0}, best_fields=True)
Q_ZERO = R.Match("library vote", weights={"title": 0.0})
Q_AUTO = R.Match("harbor vot", ("title", "content"), "and", fuzziness=R.AUTO)
Q_FUZZY = R.Match("libary counsil", ("content",), fuzziness=2)


TOGETHER = ("title", "subtitle", "description", "content")
_TEXT = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in TOGETHER) + ")"


@_query(f"WITH {ONCE} SELECT id, title, {_TEXT} AS search_text FROM a")
def articles_view(spark, d):
    docs = R.articles_once(table(spark, d, "articles"), TOGETHER)
    return docs.select("id", "title", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in TOGETHER]).alias("search_text"))


@_query("SELECT count(DISTINCT id) AS articles FROM articles")
def corpus_count(spark, d):
    return table(spark, d, "articles").agg(F.count_distinct("id").alias("articles"))


@_query(f"WITH {ONCE}, p AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest({_toks(f)}) AS term FROM a" for f in R.ALL_FIELDS) + ") SELECT field, term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY field, term")
def postings_df(spark, d):
    """Document and collection frequency of every term of every field."""
    return _index(spark, d).vocabulary.select("field", "term", "df", "cf")


@_query(f"WITH {ONCE}, " + ", ".join(f"k_{f} AS (SELECT id, {_toks(f)} AS k FROM a)" for f in R.FIELDS) + ", p AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest(k) AS term, unnest(range(len(k))) AS pos, len(k) AS dl FROM k_{f}" for f in R.FIELDS) + ") SELECT field, term, id, count(*)::INT AS tf, max(dl)::INT AS dl, (max(pos) - min(pos))::INT AS span FROM p WHERE term IN ('council', 'harbour', 'budget') GROUP BY ALL")
def stored_postings(spark, d):
    """What the index holds of three words: lengths, counts and places (from the first to the last)."""
    p = _index(spark, d).postings.where(F.col("term").isin("council", "harbour", "budget") & F.col("field").isin(*R.FIELDS))
    return p.select("field", "term", "id", "tf", "dl", (F.array_max("places") - F.array_min("places")).alias("span"))


@_query(_search_sql(R.Match("council budget")))
def dynamic_match_or(spark, d):
    """Without the index, from the texts."""
    return R.search(_docs(spark, d), R.Match("council budget"))


@_query(_search_sql(Q_OR))
def query_string_or(spark, d):
    return I.search(_index(spark, d), Q_OR)


@_query(_search_sql(Q_AND))
def query_string_and(spark, d):
    return I.search(_index(spark, d), Q_AND)


@_query(_search_sql(Q_TITLE))
def match_title_and(spark, d):
    return I.search(_index(spark, d), Q_TITLE)


@_query(_search_sql(Q_CONTENT))
def match_content_or(spark, d):
    return I.search(_index(spark, d), Q_CONTENT)


@_query(_search_sql(Q_BEST))
def multi_match_best_fields(spark, d):
    return I.search(_index(spark, d), Q_BEST)


@_query(_search_sql(Q_ZERO))
def multi_match_zero_boost(spark, d):
    """A weight of zero changes scores, never the matches."""
    return I.search(_index(spark, d), Q_ZERO)


@_query(_search_sql(Q_FUZZY))
def fuzzy_token_bm25(spark, d):
    return I.search(_index(spark, d), Q_FUZZY)


@_query(_search_sql(Q_AUTO))
def fuzzy_auto(spark, d):
    return I.search(_index(spark, d), Q_AUTO)


_COUNT = f"WITH {ONCE} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE list_contains({_toks(f)}, 'strike')) AS matches FROM a" for f in R.FIELDS)


@_query(_COUNT)
def field_match_counts(spark, d):
    one = _index(spark, d).vocabulary.where("term = 'strike'").agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("df"))), F.lit(0)).alias(f) for f in R.FIELDS])
    return one.select(F.expr(f"stack({len(R.FIELDS)}, " + ", ".join(f"'{f}', {f}" for f in R.FIELDS) + ") AS (field, matches)"))


def _padded(f: str) -> str:
    return f"' ' || array_to_string({_toks(f)}, ' ') || ' '"


@_query(f"WITH {ONCE} SELECT id, fields FROM (SELECT id, " + " + ".join(f"contains({_padded(f)}, ' in a letter to ')::INT" for f in R.FIELDS) + " AS fields FROM a) WHERE fields > 0")
def phrase_exact(spark, d):
    return I.match_phrase(_index(spark, d), R.Phrase("in a letter to")).select("id", "fields")


@_query(f"WITH {ONCE} SELECT id, fields FROM (SELECT id, " + " + ".join(f"contains({_padded(f)}, ' in a letter to ')::INT" for f in R.FIELDS) + " AS fields FROM a) WHERE fields > 0")
def dynamic_phrase(spark, d):
    return R.match_phrase(_docs(spark, d), R.Phrase("in a letter to"))


_WORDS = ["over", "the", "weekend"]
_TIMES = f"(length({{0}}) - length(replace({{0}}, ' {' '.join(_WORDS)} ', ' ')))::DOUBLE / {len(' '.join(_WORDS)) + 1}"


def _phrase_ranked_sql() -> str:
    per = []
    for f in ("title", "content"):
        idf = " + ".join(f"ln(1e0 + (n - df_{f}_{i} + 0.5e0) / (df_{f}_{i} + 0.5e0))" for i in range(3))
        per.append(f"CASE WHEN x_{f} > 0 THEN ({idf}) * x_{f} * 2.2e0 / (x_{f} + 1.2e0 * (0.25e0 + 0.75e0 * dl_{f} / avg_{f})) ELSE 0 END")
    times = ", ".join(f"{_TIMES.format(_padded(f))} AS x_{f}" for f in ("title", "content"))
    return f"WITH {_counted(_WORDS, ('title', 'content'))}, x AS (SELECT id, {times} FROM a) SELECT id, floor(({' + '.join(per)}) * 1e4 + 0.5e0) / 1e4 AS score FROM c JOIN x USING (id), s WHERE x_title + x_content > 0 ORDER BY score DESC, id DESC LIMIT 20"


@_query(_phrase_ranked_sql())
def phrase_ranked(spark, d):
    """A page of phrase matches by BM25 of the phrase."""
    return R.page(I.match_phrase(_index(spark, d), R.Phrase(" ".join(_WORDS), ("title", "content"))).select("id", "score"), 20)


def _slop_sql(words: list[str], slop: int, field: str) -> str:
    alternatives = []
    for g in range(1, slop + 2):
        chain = " AND ".join(f"len(list_filter(range(1, len(k) + 1), lambda i: k[i] = '{a}' AND k[i + {g}] = '{b}')) > 0" for a, b in zip(words, words[1:]))
        alternatives.append(f"({chain})")
    return f"WITH {ONCE}, t AS (SELECT id, {_toks(field)} AS k FROM a) SELECT id, 1 AS fields FROM t WHERE {' OR '.join(alternatives)}"


@_query(_slop_sql(["warned", "the", "could"], 2, "content"))
def phrase_slop2(spark, d):
    return I.match_phrase(_index(spark, d), R.Phrase("warned the could", ("content",), 2)).select("id", "fields")


def _boolean(spark, d, expression):
    return I.match_boolean(_index(spark, d), R.Boolean(expression)).select("id")


_ANY = f"WITH {ONCE}, t AS (SELECT id, " + " || '\n ' || ".join(_padded(f) for f in R.FIELDS) + " AS k FROM a) SELECT id FROM t WHERE "


@_query(_ANY + "contains(k, ' council ') AND NOT contains(k, ' budget ')")
def boolean_and_not(spark, d):
    return _boolean(spark, d, "council AND NOT budget")


@_query(_ANY + "contains(k, ' harbour ') AND (contains(k, ' strike ') OR contains(k, ' vote '))")
def boolean_or_group(spark, d):
    return _boolean(spark, d, "harbour (strike OR vote)")


@_query(_ANY + "contains(k, ' over the weekend ') AND contains(k, ' library ')")
def boolean_phrase(spark, d):
    return _boolean(spark, d, '"over the weekend" AND library')


@_query(_ANY + "contains(k, ' harbour ') AND (contains(k, ' strike ') OR contains(k, ' vote '))")
def dynamic_boolean(spark, d):
    return R.match_boolean(_docs(spark, d), R.Boolean("harbour (strike OR vote)"))


@_query(_ANY + "NOT contains(k, ' council ') AND NOT contains(k, ' over the weekend ')")
def boolean_only_not(spark, d):
    return _boolean(spark, d, 'NOT council NOT "over the weekend"')


@_query(f"WITH {_counted(['harbour', 'strike'], R.FIELDS)}, tt AS (SELECT id, " + " || '\n ' || ".join(_padded(f) for f in R.FIELDS) + f" AS k FROM a) SELECT id, {_bm25(['harbour', 'strike'], R.FIELDS)} AS score FROM c JOIN tt USING (id), s WHERE contains(k, ' harbour ') AND contains(k, ' strike ') AND NOT contains(k, ' budget ') {TOP.format(20)}")
def boolean_ranked(spark, d):
    """A page of boolean matches by BM25 of the words that aren't negated."""
    return R.page(I.match_boolean(_index(spark, d), R.Boolean("harbour AND strike NOT budget")), 20)


@_query(f"WITH h AS ({_search_sql(Q_OR)}), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS r FROM h) SELECT count(*) > 10 AS has_more, count(*) AS total_matches, max(score) AS max_score, max(id) FILTER (r = least(10, (SELECT count(*) FROM h))) AS last_id FROM p")
def page_contract(spark, d):
    """What a page tells besides its hits."""
    p = Q.page_of(I.search(_index(spark, d), Q_OR), 10)
    return spark.createDataFrame([(p.has_more, p.total_matches, p.max_score, R.decode_cursor(p.next_cursor)[1] if p.next_cursor else p.hits[-1]["id"] if p.hits else None)], "has_more boolean, total_matches long, max_score double, last_id string")


@_query(_search_sql(Q_OR, TOP.format(10)))
def page_first(spark, d):
    return R.page(I.search(_index(spark, d), Q_OR), 10)


@_query(f"WITH h AS ({_search_sql(Q_OR)}), p AS (SELECT * FROM h {TOP.format(10)}), l AS (SELECT * FROM p ORDER BY score, id LIMIT 1) SELECT h.id, h.score FROM h, l WHERE h.score < l.score OR h.score = l.score AND h.id < l.id ORDER BY h.score DESC, h.id DESC LIMIT 10")
def page_after_cursor(spark, d):
    hits = I.search(_index(spark, d), Q_OR)
    last = R.page(hits, 10).orderBy("score", "id").first()
    cursor = R.encode_cursor(last["score"], last["id"]) if last else None
    return R.page(hits, 10, R.decode_cursor(cursor) if cursor else None)


@_query(f"WITH h AS ({_search_sql(Q_OR)}) SELECT id, score, max(score) OVER () AS max_score, count(*) OVER () AS total_matches, floor(score / CASE WHEN max(score) OVER () > 0 THEN max(score) OVER () ELSE 1 END * 1e4 + 0.5e0) / 1e4 AS score_normalized FROM h")
def score_normalized(spark, d):
    return R.normalized(I.search(_index(spark, d), Q_OR))


@_query(f"WITH h AS ({_search_sql(Q_OR)}) SELECT id, score FROM h ORDER BY score DESC, id DESC LIMIT 10 OFFSET 10")
def offset_page(spark, d):
    return I.search(_index(spark, d), Q_OR).orderBy(F.desc("score"), F.desc("id")).offset(10).limit(10)


_ALL = f"WITH {ONCE}, t AS (SELECT id, {_toks(_TEXT)} AS k FROM a), c AS (SELECT id, len(k) AS dl_x, len(list_filter(k, lambda x: x = 'council')) AS tf_x_0, len(list_filter(k, lambda x: x = 'budget')) AS tf_x_1 FROM t), s AS (SELECT count(*) AS n, avg(dl_x) AS avg_x, count(*) FILTER (tf_x_0 > 0) AS df_x_0, count(*) FILTER (tf_x_1 > 0) AS df_x_1 FROM c)"


@_query(f"{_ALL} SELECT id, {_bm25(['council', 'budget'], ('x',))} AS score FROM c, s {TOP.format(100)}")
def rank_all_bm25(spark, d):
    """The best of the whole corpus by its fields put together, without a match condition."""
    return I.rank_all(_index(spark, d), R.Match("council budget", TOGETHER), 100)


_VALID = f"len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
VECTORS = f"v AS (SELECT article_id AS id, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS r FROM article_embeddings WHERE model_name = '{MODEL}' AND {_VALID}) WHERE r = 1), q AS (SELECT e AS w FROM v ORDER BY id LIMIT 1)"
DISTANCE = "floor((1e0 - list_cosine_similarity(e, w)) * 1e6 + 0.5e0) / 1e6"


def versions(spark: SparkSession, d: str) -> DataFrame:
    """All usable vectors: (id, embedding, version); the highest version of an id is its latest."""
    ok = F.expr(f"size(embedding) = {DIM} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    own = table(spark, d, "article_embeddings").where((F.col("model_name") == MODEL) & ok)
    return own.select(F.col("article_id").alias("id"), "embedding", F.struct("created_at", F.col("id").alias("row")).alias("version"))


def _query_vector(v: DataFrame) -> list[float]:
    first = v.orderBy("id", F.desc("version")).limit(1).collect()
    return list(first[0]["embedding"]) if first else []


@_query(f"WITH {VECTORS} SELECT id, {DISTANCE} AS distance FROM v, q ORDER BY distance, id LIMIT 20")
def semantic_topk(spark, d):
    v = versions(spark, d)
    return R.nearest(v, _query_vector(v), 20)


@_query(f"WITH {VECTORS} SELECT id, {DISTANCE} AS distance FROM v, q WHERE {DISTANCE} < 0.7e0 ORDER BY distance, id LIMIT 100")
def semantic_threshold(spark, d):
    v = versions(spark, d)
    return R.nearest(v, _query_vector(v), 100, 0.7)


@_query(f"WITH {VECTORS}, {ONCE}, n AS (SELECT id, {DISTANCE} AS distance FROM v, q ORDER BY distance, id LIMIT 20) SELECT n.id, distance, title FROM n JOIN a USING (id)")
def semantic_join_articles(spark, d):
    v = versions(spark, d)
    return _docs(spark, d).select("id", "title").join(R.nearest(v, _query_vector(v), 20), "id").select("id", "distance", "title").distinct()


@_query("SELECT true AS enough")
def ann_recall(spark, d):
    """Whether the stored cells give nine tenths of the exact twenty neighbours of five vectors, one query after the other."""
    v = versions(spark, d)
    index = A.build(v, DIM, cell=128)
    some = [list(r["embedding"]) for r in v.orderBy("id", F.desc("version")).limit(5).collect()]
    shares = [A.recall(A.nearest(index, q, 20), R.nearest(v, q, 20)) for q in some]
    return spark.createDataFrame([(not shares or sum(shares) / len(shares) >= 0.9,)], "enough boolean")


Q_HYBRID = R.Match("council budget", ("title", "content"))
_LEGS = f"{VECTORS}, l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id DESC) AS rank FROM ({_search_sql(Q_HYBRID, TOP.format(200))})), m AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT id, {DISTANCE} AS distance FROM v, q ORDER BY distance, id LIMIT 200))"
_FUSED = "SELECT coalesce(l.id, m.id) AS id, floor((coalesce(1e0 / (60e0 + l.rank), 0) + coalesce(1e0 / (60e0 + m.rank), 0)) * 1e6 + 0.5e0) / 1e6 AS score FROM l FULL JOIN m ON l.id = m.id"


def _legs(spark, d):
    v = versions(spark, d)
    lexical = R.with_ranks(I.search(_index(spark, d), Q_HYBRID), R.CANDIDATES, [F.desc("score"), F.desc("id")])
    semantic = R.with_ranks(R.nearest(v, _query_vector(v), R.CANDIDATES), R.CANDIDATES, [F.col("distance"), F.col("id")])
    return lexical, semantic


@_query(f"WITH {_LEGS} {_FUSED} ORDER BY score DESC, id DESC LIMIT 20")
def hybrid_rrf(spark, d):
    return R.top(R.fuse(*_legs(spark, d)), 20)


@_query(f"WITH {_LEGS} SELECT count(*) AS total FROM ({_FUSED})")
def hybrid_rrf_total(spark, d):
    return R.fuse(*_legs(spark, d)).agg(F.count("*").alias("total"))


@_query(f"WITH {_LEGS} SELECT coalesce(l.id, m.id) AS id, floor((0.5e0 * coalesce(l.score, 0) + 0.5e0 * coalesce(1e0 - distance, 0)) * 1e4 + 0.5e0) / 1e4 AS score FROM l FULL JOIN m ON l.id = m.id ORDER BY score DESC, id DESC LIMIT 20")
def hybrid_weighted(spark, d):
    lexical, semantic = _legs(spark, d)
    return R.top(R.fuse_weighted(lexical, semantic.select("id", (1 - F.col("distance")).alias("score"))), 20)


def _trigrams(words: str) -> str:
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@_query(f"WITH {ONCE}, t AS (SELECT id, {_trigrams(_toks('title'))} AS x, {_trigrams(_toks(chr(39) + 'senat resored' + chr(39)))} AS y FROM a), u AS (SELECT id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0 END AS raw FROM t) SELECT id, floor(raw * 1e4 + 0.5e0) / 1e4 AS score FROM u WHERE raw > 0.2e0")
def fuzzy_trigram(spark, d):
    s = T.trigram_similarity(F.col("title"), F.lit("senat resored"))
    return _docs(spark, d).select("id", s.alias("raw")).where("raw > 0.2D").select("id", T.round4(F.col("raw")).alias("score")).distinct()


@_query(f"WITH {ONCE}, t AS (SELECT id, {_trigrams(_toks(BOTH))} AS x, {_trigrams(_toks(chr(39) + 'the senate was restored and the permit audited as the town awaits public evacuation' + chr(39)))} AS y FROM a), u AS (SELECT id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0 END AS raw FROM t) SELECT id, floor(raw * 1e4 + 0.5e0) / 1e4 AS score FROM u WHERE raw > 0.15e0")
def fuzzy_trigram_fields(spark, d):
    """Title and description together, with the lower bound."""
    s = T.trigram_similarity(F.concat_ws(" ", "title", "description"), F.lit("the senate was restored and the permit audited as the town awaits public evacuation"))
    return _docs(spark, d).select("id", s.alias("raw")).where("raw > 0.15D").select("id", T.round4(F.col("raw")).alias("score")).distinct()


@_query(f"WITH {ONCE} SELECT id, len(list_filter(string_split(lower(coalesce(title, '')), ' '), lambda w: levenshtein(w, 'senat') <= 2)) AS near FROM a WHERE len(list_filter(string_split(lower(coalesce(title, '')), ' '), lambda w: levenshtein(w, 'senat') <= 2)) > 0")
def fuzzy_levenshtein(spark, d):
    near = F.size(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), " "), lambda w: F.levenshtein(w, F.lit("senat"), 2) >= 0))
    return _docs(spark, d).select("id", near.alias("near")).where("near > 0").distinct()


@_query(r"WITH a AS (SELECT id, max(content) AS content FROM articles GROUP BY id), p AS (SELECT id, content, regexp_extract(lower(content), '\b(harbour|strike)\b') AS w FROM a), f AS (SELECT id, content, least(coalesce(nullif(length(regexp_extract(lower(content), '^((?s:.*?))\b(?:harbour|strike)\b', 1)), 0), 0) + 1, length(content)) AS pos FROM p WHERE w <> '') SELECT id, regexp_replace(substr(content, greatest(pos - 40, 1), 160), '\b(harbour|strike)\b', '[\1]', 'gi') AS headline FROM f")
def headlines(spark, d):
    """A stretch of each text around the first of two words, both in brackets."""
    return R.articles_once(_docs(spark, d), ("content",)).select("id", T.headline(F.col("content"), ["harbour", "strike"]).alias("headline")).where("headline IS NOT NULL")


@_query(f"WITH {ONCE}, t AS (SELECT id, {_toks('content')} AS k FROM a) SELECT id FROM t WHERE len(list_filter(range(1, len(k) + 1), lambda i: k[i] = 'council' AND list_contains(k[greatest(i - 5, 1):i + 5], 'budget'))) > 0")
def proximity_unordered(spark, d):
    return I.near(_index(spark, d), "council", "budget", 5, "content")


@_query(f"WITH {ONCE}, t AS (SELECT id, {_toks('content')} AS k FROM a) SELECT id FROM t WHERE len(list_filter(range(1, len(k) + 1), lambda i: k[i] = 'council' AND list_contains(k[i + 1:i + 8], 'budget'))) > 0")
def proximity_ordered(spark, d):
    return I.near(_index(spark, d), "council", "budget", 8, "content", ordered=True)


@_query(f"WITH {ONCE}, t AS (SELECT id, {_toks('title')} AS k FROM a) SELECT id, 2e0 AS score FROM t WHERE list_has_any(k, ['council', 'harbour', 'library'])")
def term_set_constant(spark, d):
    """Any of a set of terms, all with one score."""
    return I.term_set(_index(spark, d), ["council", "harbour", "library"], ("title",), 2.0)


@_query(f"WITH {ONCE}, t AS (SELECT id, {_toks('content')} AS k FROM a) SELECT id, len(list_filter(k, lambda x: starts_with(x, 'librar'))) AS hits FROM t WHERE len(list_filter(k, lambda x: starts_with(x, 'librar'))) > 0")
def prefix_terms(spark, d):
    return I.prefix(_index(spark, d), "librar", ("content",))


@_query(f"WITH {ONCE}, t AS (SELECT id, content, instr(lower(content), 'harbour') AS p FROM a) SELECT id, substr(content, greatest(p - 40, 1), p - greatest(p - 40, 1)) || '[' || substr(content, p, 7) || ']' || substr(content, p + 7, 40) AS snippet FROM t WHERE p > 0")
def snippets(spark, d):
    return _docs(spark, d).select("id", T.snippet(F.col("content"), "harbour").alias("snippet")).where("snippet IS NOT NULL").distinct()


# Surface forms of the queried stems, by hand: the SQL has no stemmer.
_FORMS = {"library": ["library", "libraries", "librarys"], "restored": ["restore", "restored", "restores", "restoring"], "council": ["council", "councils"], "budget": ["budget", "budgets", "budgeted", "budgeting"]}
_LABELLED = (("title", 1.0), ("description", 0.4), ("content", 0.2), ("subtitle", 0.1), ("author", 0.1))


def _places(words: list[str]) -> str:
    """CTEs: g (id, lexeme number i, place, weight), in the order of the fields."""
    lists = ", ".join(f"{_toks(f)} AS k_{f}" for f, _ in _LABELLED)
    parts = []
    for n, (f, w) in enumerate(_LABELLED):
        before = " + ".join(["0", *(f"len(k_{g})" for g, _ in _LABELLED[:n])])
        parts += [f"SELECT id, {i} AS i, {before} + unnest(list_filter(range(1, len(k_{f}) + 1), lambda p: list_contains({_FORMS[word]!r}, k_{f}[p]))) AS place, {w}e0 AS w FROM t" for i, word in enumerate(words)]
    return f"{ONCE}, t AS (SELECT id, {lists} FROM a), g AS ({' UNION ALL '.join(parts)})"


def _rank_or_sql(words: list[str]) -> str:
    return f"""WITH {_places(words)}, o AS (SELECT id, i, w, row_number() OVER (PARTITION BY id, i ORDER BY place) AS j FROM g),
b AS (SELECT id, i, max(w) AS best, sum(w / (j * j)) AS series, arg_min(j, (-w, j)) AS first FROM o GROUP BY ALL)
SELECT id, floor(sum((best + series - best / (first * first)::DOUBLE) / 1.64493406685e0) / {len(words)} * 1e4 + 0.5e0) / 1e4 AS score FROM b GROUP BY id"""


def _rank_and_sql(words: list[str], phrase: bool = False) -> str:
    apart = "JOIN (SELECT DISTINCT a.id FROM g a JOIN g b ON a.id = b.id AND a.i = 0 AND b.i = 1 AND b.place = a.place + 1) USING (id)" if phrase else ""
    return f"""WITH {_places(words)}, p AS (SELECT a.id, abs(a.place - b.place) AS d, a.w AS u, b.w AS v FROM g a JOIN g b ON a.id = b.id AND a.i < b.i)
SELECT id, floor((1 - product(1 - sqrt(u * v * CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005e0 + 0.05e0 * exp(d / 1.5e0 - 2)) END))) * 1e4 + 0.5e0) / 1e4 AS score FROM p {apart} GROUP BY id"""


@_query(f"WITH k AS ({_rank_or_sql(['library'])}) SELECT id, coalesce(score, 0) AS score FROM (SELECT id, max(title) AS title FROM articles GROUP BY id) LEFT JOIN k USING (id) WHERE len(list_filter(string_split(lower(coalesce(title, '')), ' '), lambda w: levenshtein(w, 'libary') <= 2)) > 0 ORDER BY score DESC, id DESC LIMIT 20")
def fuzzy_levenshtein_ranked(spark, d):
    """Titles with a word near a misspelt one, ranked by the word that was meant."""
    near = F.exists(F.split(F.lower(F.coalesce("title", F.lit(""))), " "), lambda w: F.levenshtein(w, F.lit("libary"), 2) >= 0)
    hits = R.articles_once(_docs(spark, d), ("title",)).where(near).select("id")
    ranked = I.ts_rank(_index(spark, d), "library")
    return R.top(hits.join(ranked, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), 20)


@_query(_rank_or_sql(["restored", "council"]))
def stemmed_match_tsrank(spark, d):
    """Stemmed words in labelled fields; either counts."""
    return I.ts_rank(_index(spark, d), "restored councils")


@_query(_rank_and_sql(["library", "budget"]))
def tsrank_and(spark, d):
    """Both words, and a stop word that counts for nothing."""
    return I.ts_rank(_index(spark, d), "the libraries budget", "and")


@_query(_rank_and_sql(["restored", "library"], phrase=True))
def tsrank_phrase(spark, d):
    return I.ts_rank(_index(spark, d), "restore library", "phrase")


@_query(_rank_or_sql(["library"]).replace("FROM g)", "FROM g WHERE w >= 0.4e0)"))
def tsrank_labels(spark, d):
    """Only the fields with labels A and B."""
    return I.ts_rank(_index(spark, d), "libraries", fields=("title", "description"))


@_query("WITH i AS (SELECT DISTINCT doc_id AS id FROM runs WHERE rank <= 3) SELECT id, max(title) AS title FROM articles WHERE id IN (SELECT id FROM i) GROUP BY id")
def lookup_by_ids(spark, d):
    ids = table(spark, d, "runs").where("rank <= 3").select(F.col("doc_id").alias("id"))
    return R.articles_once(embeddings.by_ids(table(spark, d, "articles"), ids), ("title",))


@_query(f"WITH {VECTORS}, i AS (SELECT DISTINCT doc_id AS id FROM runs WHERE rank <= 3) SELECT id, len(e) AS size, floor(list_sum(list_transform(e, lambda x: abs(x))) * 1e4 + 0.5e0) / 1e4 AS total, floor(e[1] * 1e6 + 0.5e0) / 1e6 AS first FROM v WHERE id IN (SELECT id FROM i)")
def vectors_by_ids(spark, d):
    ids = table(spark, d, "runs").where("rank <= 3").select(F.col("doc_id").alias("id"))
    own = embeddings.by_ids(versions(spark, d), ids)
    total = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return own.groupBy("id").agg(F.max_by("embedding", "version").alias("embedding")).select("id", F.size("embedding").cast("long").alias("size"), T.round4(total).alias("total"), (F.floor(F.col("embedding")[0].cast("double") * 1e6 + 0.5) / 1e6).alias("first"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
