"""Queries of the general problems: 2 (timestamps) and 7 (records that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators import articles
from pressmill.operators.timestamps import resolve_instants
from pressmill.session import table
from pressmill.sources.records import parse_records, preprocess_report


def _instants(spark: SparkSession, d: str, declared: bool) -> DataFrame:
    rows = table(spark, d, "articles").select("id", F.col("published_at").alias("value"), F.col("metadata.source_name").alias("source"), F.col("created_at").alias("at"))
    sources = table(spark, d, "publications").select(F.col("source_name").alias("source"), "home_zone", "date_order")
    return resolve_instants(rows, sources, declared)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d, True)


def p2_inferred_order(spark: SparkSession, d: str) -> DataFrame:
    """The same without the declared day and month order: the sequence of each source decides."""
    return _instants(spark, d, False)


def _parsed(spark: SparkSession, d: str, guarded: bool = False) -> DataFrame:
    return parse_records(table(spark, d, "raw_records"), table(spark, d, "field_mappings"), guarded)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason IS NOT NULL").select("record_id", "reason")


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason IS NULL").select("record_id", "dataset", "batch", F.to_json("fields").alias("fields"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    r = preprocess_report(_parsed(spark, d))
    return r.withColumn("drops", F.to_json("drops"))


def mapped_articles(spark: SparkSession, d: str) -> DataFrame:
    """The records that load, as article rows."""
    return articles.as_articles(_parsed(spark, d, guarded=True))


def articles_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The articles, then the mapped records over them."""
    current = table(spark, d, "articles").select("id", "title", "content", "created_at").dropDuplicates(["id"])
    return articles.upsert(current, mapped_articles(spark, d).select("id", "title", "content", "created_at")).select("id", "title")


_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_TIME = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?|T\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2}))"
# Records by regular expressions over the whole raw text; both CSV feeds have ten columns.
_PARSED = rf"""
r AS (SELECT record_id, dataset, fmt, batch, raw, regexp_replace(raw, '\r?\n$', '') AS line FROM raw_records),
c AS (SELECT *, CASE WHEN fmt = 'csv' THEN coalesce(regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{9}}'), false) ELSE coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' AND NOT regexp_matches(raw, ',\s*\}}\s*$'), false) END AS readable FROM r),
f AS (SELECT c.record_id, c.dataset, c.batch, m.pos, m.source_type AS kind, m.target_field AS target, m.required,
CASE WHEN c.fmt = 'csv' THEN regexp_extract_all(',' || line, ',({_FIELD})', 1)[m.pos] ELSE json_extract_string(raw, '$.' || m.source_field) END AS cell, c.fmt
FROM c JOIN field_mappings m ON m.dataset = c.dataset AND m.fmt = c.fmt WHERE readable),
v AS (SELECT *, CASE WHEN fmt = 'csv' AND cell[1:1] = '"' THEN replace(cell[2:-2], '""', '"') ELSE cell END AS v FROM f),
w AS (SELECT *, CASE WHEN v IS NULL THEN 'missing_source_column' WHEN regexp_full_match(v, '{_WHITE}*') THEN 'empty_required_value'
WHEN kind = 'int' AND (NOT regexp_full_match(v, '[+-]?\d+') OR try_cast(v AS BIGINT) IS NULL) OR kind = 'bool' AND v NOT IN ('1','t','T','TRUE','true','True','0','f','F','FALSE','false','False')
OR kind = 'uuid' AND NOT regexp_full_match(lower(regexp_replace(v, '^[uU][rR][nN]:[uU][uU][iI][dD]:', '')), '[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}|\{{[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}\}}|[0-9a-f]{{32}}')
OR kind = 'url' AND NOT regexp_matches(trim(v), '^[hH][tT][tT][pP][sS]?://[^/?#\s:]+(?::\d*)?(?:[/?#]|$)')
OR kind = 'datetime' AND (NOT regexp_full_match(v, '{_TIME}') OR try_cast(replace(v[:10] || ' ' || regexp_extract(v, '[ T](\d{{1,2}}:\d{{2}}:\d{{2}})', 1), ',', '.') AS TIMESTAMP) IS NULL OR v[:4] = '0000') THEN 'conversion_failed' END AS fault FROM v),
d AS (SELECT record_id, arg_min(fault || '/' || target, pos) AS reason FROM w WHERE required AND fault IS NOT NULL GROUP BY record_id),
p AS (SELECT c.record_id, c.dataset, c.batch, CASE WHEN NOT readable THEN 'read_failed' ELSE d.reason END AS reason FROM c LEFT JOIN d USING (record_id))"""


_MONTH_LISTS = (
    "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec", "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "januar februar mart april maj jun jul avgust septembar oktobar novembar decembar", "јануар фебруар март април мај јун јул август септембар октобар новембар децембар",
)
_MONTH = "coalesce(" + ", ".join(f"nullif(list_position({x.split()!r}, lower(name)), 0)" for x in _MONTH_LISTS) + ", CASE lower(name) WHEN 'sept' THEN 9 END)"
_EAST = {
    0: "Z UT UTC GMT WET", 60: "WEST BST CET MEZ", 120: "CEST MESZ EET", 180: "EEST MSK", 330: "IST", 480: "HKT SGT AWST", 540: "JST KST", 570: "ACST", 630: "ACDT", 600: "AEST", 660: "AEDT", 720: "NZST", 780: "NZDT",
    -300: "EST CDT", -240: "EDT", -360: "CST MDT", -420: "MST PDT", -480: "PST AKDT", -540: "AKST", -600: "HST",
}
_ABBREVIATED = "CASE " + " ".join(f"WHEN abbr IN ({', '.join(repr(x) for x in names.split())}) THEN {m}" for m, names in _EAST.items()) + " END"
_CLOCK = r"(?:(?:T|t|[\s,.]+(?:(?:à|at|um|u|у|a\s+las|-)\s+)?)(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*(?:Uhr|uhr|h|часова|časova))?)?"
_PLACE = r"(?:\s*([+-]\d{2}:?\d{2}|[+-]\d{2})|\s*([A-Z]{1,5})([+-]\d{1,2}(?::?\d{2})?)?)?(?:\s*\[([A-Za-z_+\-/0-9]+)\])?(?:\s*\([A-Za-z ]+\))?$"
_NAMES = "['h', 'mi', 's', 'f', 'ap', 'off', 'abbr', 'aoff', 'zone']"
_DAY = r"(?:\pL{2,12}\.?,?\s+)?"
_DATES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(.*)$", "['y', 'mo', 'd', 'tail']"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\.?(.*)$", "['a', 'b', 'y', 'tail']"),
    (rf"^{_DAY}(\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s*-?(?:de\s+)?(\pL{{3,12}})\.?,?\s*-?(?:de\s+|del\s+)?(\d{{4}})\.?(.*)$", "['d', 'name', 'y', 'tail']"),
    (rf"^{_DAY}(\pL{{3,12}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(.*)$", "['name', 'd', 'y', 'tail']"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?)?" + _PLACE, "['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'off', 'abbr', 'aoff', 'zone']"),
)


def _instants_sql() -> str:
    """published_at read form by form, by the rules of the data; local times by the zones of the database."""
    sign = lambda x: f"CASE WHEN {x}[1:1] = '-' THEN -1 ELSE 1 END"
    digits = lambda x: f"replace({x}[2:], ':', '')"
    minutes = lambda x: f"({sign(x)} * (60 * left({digits(x)}, CASE WHEN length({digits(x)}) IN (1, 3) THEN 1 ELSE 2 END)::INT + CASE WHEN length({digits(x)}) > 2 THEN right({digits(x)}, 2)::INT ELSE 0 END))"
    forms = []
    for k, (form, names) in enumerate(_DATES):
        part = lambda c, names=names: f"x.{c}" if f"'{c}'" in names else "''"
        tail = "x" if k == 4 else f"regexp_extract(x.tail, '^{_CLOCK}{_PLACE}', {_NAMES})"
        fits = "true" if k == 4 else f"regexp_matches(x.tail, '^{_CLOCK}{_PLACE}')"
        t = lambda c, k=k: "''" if k == 4 and c == "ap" else f"t.{c}"
        forms.append(
            f"SELECT id, zone AS home, date_order, {k} AS form, {part('y')} AS y, {part('mo')} AS mo, {part('d')} AS d, {part('a')} AS a, {part('b')} AS b, {part('name')} AS name, {', '.join(f'{t(c)} AS {c}' for c in ('h', 'mi', 's', 'f', 'ap', 'off', 'abbr', 'aoff', 'zone'))} "
            f"FROM (SELECT *, {tail} AS t FROM (SELECT id, zone, date_order, regexp_extract(v, '{form}', {names}) AS x FROM v WHERE regexp_matches(v, '{form}') AND NOT counted) WHERE {fits})"
        )
    return f"""
WITH v AS (SELECT DISTINCT a.id, regexp_replace(a.published_at, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS v, p.home_zone AS zone, p.date_order,
regexp_full_match(regexp_replace(a.published_at, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '[0-9]+') AND length(trim(a.published_at)) <> 8 AND NOT (length(trim(a.published_at)) = 14 AND left(trim(a.published_at), 2) IN ('19', '20')) AS counted
FROM articles a LEFT JOIN publications p ON lower(trim(p.source_name)) = lower(trim(a.metadata.source_name)) WHERE a.published_at IS NOT NULL),
n AS (SELECT id, CASE WHEN length(v) BETWEEN 9 AND 11 THEN try_cast(v AS HUGEINT) * 1000000 WHEN length(v) BETWEEN 12 AND 14 THEN try_cast(v AS HUGEINT) * 1000 WHEN length(v) BETWEEN 15 AND 17 THEN try_cast(v AS HUGEINT) WHEN length(v) BETWEEN 18 AND 20 THEN try_cast(v AS HUGEINT) // 1000 END AS us FROM v WHERE counted),
f AS ({" UNION ALL ".join(forms)}),
m AS (SELECT * EXCLUDE (mo, d), CASE WHEN form IN (2, 3) THEN {_MONTH} WHEN form = 1 THEN CASE WHEN date_order = 'mdy' THEN a ELSE b END::INT ELSE mo::INT END AS mo, CASE WHEN form = 1 THEN CASE WHEN date_order = 'mdy' THEN b ELSE a END ELSE d END::INT AS d,
coalesce(nullif(h, '')::INT, 0) AS hour FROM f),
c AS (SELECT *, CASE WHEN ap = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END END AS hh FROM m WHERE mo IS NOT NULL),
o AS (SELECT DISTINCT ON (id) *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y::INT, mo, d, hh, coalesce(nullif(mi, '')::INT, 0), coalesce(nullif(s, '')::INT, 0)) AS TIMESTAMP) AS ts FROM c ORDER BY id, form),
z AS (SELECT *, CASE WHEN off <> '' THEN {minutes('off')} WHEN abbr <> '' THEN {_ABBREVIATED} + CASE WHEN aoff <> '' THEN {minutes('aoff')} ELSE 0 END END AS east, CASE WHEN off = '' AND abbr = '' THEN coalesce(nullif(zone, ''), home) END AS local FROM o WHERE ts IS NOT NULL AND y::INT >= 2 AND hh < 24),
u AS (SELECT id, f, CASE WHEN local IS NOT NULL THEN CASE WHEN timezone(local, timezone(local, ts) - INTERVAL 1 HOUR) = ts THEN timezone(local, ts) - INTERVAL 1 HOUR ELSE timezone(local, ts) END WHEN east IS NOT NULL THEN timezone('UTC', ts - to_minutes(east)) END AS t FROM z)
SELECT id, us::BIGINT AS published_us FROM n WHERE us IS NOT NULL UNION ALL
SELECT id, epoch_us(t) + rpad(left(f, 6), 6, '0')::BIGINT AS published_us FROM u WHERE t IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    own = "max(v) FILTER (target = '{}' AND fault IS NULL)"
    return {
        "p2_found": _instants_sql(),
        "p7_found": f"WITH {_PARSED} SELECT record_id, reason FROM p WHERE reason IS NOT NULL",
        "p7_report": f"""WITH {_PARSED}, n AS (SELECT dataset, batch, reason, count(*) AS n FROM p GROUP BY ALL)
SELECT dataset, batch, sum(n)::BIGINT AS total_records, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS processed_records, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped_records,
'{{' || coalesce(string_agg('"' || reason || '":' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') || '}}' AS drops FROM n GROUP BY dataset, batch""",
        "articles_upsert": f"""WITH {_PARSED}, n AS (SELECT coalesce(lower(replace(replace(regexp_replace({own.format("ID")}, '^[uU][rR][nN]:[uU][uU][iI][dD]:', ''), '{{', ''), '}}', '')), sha1(coalesce(trim({own.format("URL")}), {own.format("Title")}, record_id::VARCHAR))) AS id, {own.format("Title")} AS title
FROM w JOIN p USING (record_id) WHERE p.reason IS NULL GROUP BY record_id)
SELECT id, max(title) AS title FROM n GROUP BY id UNION ALL SELECT id, max(title) FROM articles WHERE id NOT IN (SELECT id FROM n) GROUP BY id""",
    }


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_inferred_order, p7_found, p7_loaded, p7_report, mapped_articles, articles_upsert)}
