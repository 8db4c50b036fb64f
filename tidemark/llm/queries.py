"""The operators applied to the driver's tables, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontamination, licenses, neardup, packing, quality, secrets, sharding, warc, weak
from tidemark.llm.common import ship


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


#: The argument schemas of the tools that conversations may call.
TOOLS = {"search": {"query": "string", "limit?": "integer"}, "calculate": {"expression": "string"}, "fetch": {"url": "string"}}


def op1_chat_formatting(spark: SparkSession, base: str) -> DataFrame:
    return chat.format_chats(_read(spark, base, "conversations"), TOOLS)


def op2_secret_scans(spark: SparkSession, base: str) -> DataFrame:
    return secrets.secret_report(_read(spark, base, "documents"))


def op3_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    return quality.judge(_read(spark, base, "documents"), _read(spark, base, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, base, "documents"), neardup.Rule(words=3, percent=85))


def op5_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_documents(_read(spark, base, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, base, "documents"), _read(spark, base, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_license_scans(spark: SparkSession, base: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, base, "documents"))


def op8_warc(spark: SparkSession, base: str) -> DataFrame:
    history = warc.archive_pages(_read(spark, base, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    return weak.classify(_read(spark, base, "documents"))


def op10_sharding(spark: SparkSession, base: str) -> DataFrame:
    return sharding.documents_to_shards(_read(spark, base, "documents")).drop("row_number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_secret_scans": op2_secret_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_license_scans": op7_license_scans,
    "op8_warc": op8_warc,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sharding": op10_sharding,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECON_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Located matches of one kind: what stands between matches gives their places."""
    p = _quoted(pattern)
    return f"""SELECT r, '{kind}' AS k, {rank} AS n, what, s, s + length(what) AS e FROM (
SELECT r, z.f AS what, sum(length(z.g)) OVER w + coalesce(sum(length(z.f)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
FROM (SELECT r, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'i': i, 'f': f[i], 'g': g[i]}})) AS z FROM
(SELECT r, regexp_extract_all(t, {p}) AS f, regexp_split_to_array(t, {p}) AS g FROM d)) WINDOW w AS (PARTITION BY r ORDER BY z.i)) WHERE {keep}"""


_KINDS = " UNION ALL ".join(
    (
        _matches("assign", 0, secrets.ASSIGN, f"length(regexp_extract(what, {_quoted(secrets.ASSIGN)}, 1)) >= {secrets.ASSIGN_LEAST}"),
        _matches("access", 1, "AKIA[A-Z0-9]+", "length(what) >= 20"),
        _matches("hex", 2, "[0-9a-f]+", "length(what) >= 24"),
    )
)
_HEX, _MIXED, _ALPHANUMERIC = secrets.CLASSES
_HAS = "regexp_matches(what, '[{}]')"
_LIMIT = (
    f"CASE WHEN regexp_matches(what, {_quoted(_HEX[1])}) THEN {_HEX[2]} WHEN {_HAS.format('a-z')} AND {_HAS.format('A-Z')} AND {_HAS.format('0-9')} THEN {_MIXED[2]}"
    f" WHEN {_HAS.format('A-Za-z')} AND {_HAS.format('0-9')} THEN {_ALPHANUMERIC[2]} END"
)
_UNKNOWN = " AND ".join(f"NOT regexp_matches(what, {_quoted(p)})" for p in secrets.ALLOWED)

ORACLE_SQL: dict[str, str] = {
    # For messages without tool calls, which are all that the table holds.
    "op1_chat_formatting": """
SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid, CAST(NULL AS INTEGER) AS level,
  '{"content":' || to_json(coalesce(text, '')) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message
FROM conversations""",
    "op2_secret_scans": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_KINDS}),
c AS (SELECT *, {_LIMIT} AS bits FROM ({_matches("entropy", 3, secrets.CANDIDATE, _UNKNOWN)})),
h AS (SELECT r, k, n, s, list_filter(range(1, CAST(length(what) AS BIGINT) - {secrets.WINDOW - 2}), lambda i: list_entropy(string_split(substr(what, i, {secrets.WINDOW}), '')) >= bits - 1e-9) AS dense FROM c WHERE bits IS NOT NULL),
x AS (SELECT r, k, n, s + list_min(dense) - 1 AS s, s + list_max(dense) + {secrets.WINDOW - 1} AS e FROM h WHERE len(dense) > 0),
a AS (SELECT r, k, n, s, e FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s <= x.s AND b.e >= x.e)),
g AS (SELECT r, count(*) FILTER (WHERE k = 'assign') AS n_assign, count(*) FILTER (WHERE k = 'access') AS n_access, count(*) FILTER (WHERE k = 'hex') AS n_hex,
  coalesce(string_agg(k || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, n) FILTER (WHERE n < 3), '') AS base,
  string_agg(k || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, n) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)""",
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_DECON_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_DECON_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, dw.n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    # Ten hexadecimal digits at a time make eight of base 32.
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (html)""",
}
