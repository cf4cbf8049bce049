"""The queries of the general problems (1, 3 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.operators import orphans as o, profile as p, snapshots as s
from attesta.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return o.orphan_references(table(spark, d, "verify_log"), table(spark, d, "pages"), table(spark, d, "registry"), table(spark, d, "registry_removals"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "ref_month", "ref_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return o.orphan_report(_orphans(spark, d))


def p1_filter(spark: SparkSession, d: str) -> DataFrame:
    """What the filter proves by itself: at least nine tenths of the missing references of each table?"""
    judged = o.judged_references(table(spark, d, "verify_log"), table(spark, d, "pages"), table(spark, d, "registry"), table(spark, d, "registry_removals"))
    return o.filter_report(judged).withColumn("mostly_proved", F.col("n_proved") >= 0.9 * F.col("n_missing")).drop("n_proved")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p.registry_cases(table(spark, d, "registry"), table(spark, d, "transaction_types"))


PROFILED = ("iis_no", "subject_name", "company_name", "address", "emb_id", "transaction_type", "attachment_ref", "source", "first_seen", "last_verified", "row_no")


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return p.profile(table(spark, d, "registry"), "load_no", PROFILED)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The induced expressions, and how much of each load they cover."""
    registry, types = table(spark, d, "registry"), table(spark, d, "transaction_types")
    others, lists = p.registry_terms(registry, types)
    return p.coverage(registry, "load_no", p.CASE_COLUMNS, p.registry_expressions(registry, types), others, lists)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return s.snapshot_changes(table(spark, d, "registry_snapshots"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.change_counts(p4_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_filter, p3_found, p3_profile, p3_coverage, p4_found, p4_counts)}


def _canon(c: str) -> str:
    return f"nullif(regexp_extract(upper({c}), 'R1-[0-9]{{4}}-[0-9]{{4,}}', 0), '')"


def _key(c: str) -> str:
    return f"coalesce({_canon(c)}, nullif(upper(trim({c})), ''))"


_P1 = f"""
WITH refs AS (
  SELECT 'verify_log' AS src_table, CAST(id AS VARCHAR) AS ref_key, {_key('resolved_iis_no')} AS k, ts AS at_ts FROM verify_log
  UNION ALL
  SELECT 'pages', {_key('iis_no')} || '/p' || coalesce(CAST(page_no AS VARCHAR), ''), {_key('iis_no')}, created_at FROM pages
), reg AS (SELECT {_key('iis_no')} AS k, min(first_seen) AS since FROM registry GROUP BY 1),
gone AS (SELECT {_key('iis_no')} AS k, min(removed_at) AS until_ts FROM registry_removals GROUP BY 1),
judged AS (
  SELECT src_table, strftime(at_ts AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, ref_key,
    CASE WHEN reg.k IS NULL THEN 'missing' WHEN since > at_ts THEN 'early' WHEN until_ts <= at_ts THEN 'removed' END AS reason
  FROM refs LEFT JOIN reg ON refs.k = reg.k LEFT JOIN gone ON refs.k = gone.k WHERE refs.k IS NOT NULL
), found AS (SELECT src_table, ref_month, ref_key, min(reason) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3)
"""

_BLANK = "coalesce(trim(v), '') = ''"
_CELLS = f"""
  SELECT load_no, row_no, 'transaction_type' AS f, transaction_type AS v, coalesce(transaction_type IN (SELECT type_name FROM transaction_types), false) AS ok FROM registry
  UNION ALL SELECT load_no, row_no, 'emb_id', emb_id, coalesce(regexp_full_match(emb_id, 'EMBR1-[0-9]{{7}}-[0-9]{{2}}'), false) FROM registry
  UNION ALL SELECT load_no, row_no, 'attachment_ref', attachment_ref, coalesce(attachment_ref = {_canon('iis_no')} || '/', false) FROM registry
"""
_COVERAGE = f"""
WITH cells AS ({_CELLS}), n AS (
  SELECT load_no, f, count(*) AS n, count(*) FILTER (NOT ({_BLANK})) AS n_filled, count(*) FILTER (NOT ({_BLANK}) AND NOT ok) AS n_bad FROM cells GROUP BY 1, 2
), c AS (SELECT *, round(1 - n_bad / CAST(n AS DOUBLE), 6) AS coverage FROM n), m AS (SELECT f, round(median(coverage), 6) AS usual FROM c GROUP BY 1)
SELECT load_no, c.f AS field_name,
  CASE c.f WHEN 'transaction_type' THEN '{{transaction_types}}' WHEN 'emb_id' THEN 'EMBR1\\-[0-9]{{7}}\\-[0-9]{{2}}' ELSE '{{iis_no}}/' END AS expression,
  n_filled, n_filled - n_bad AS n_fit, coverage, usual, abs(coverage - usual) > 0.2 AS differs
FROM c JOIN m ON c.f = m.f
"""
_TEXTS = {c: c for c in PROFILED} | {c: f"regexp_replace(strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f'), '[.]?0{{1,6}}$', '')" for c in ("first_seen", "last_verified")} | {"row_no": "CAST(row_no AS VARCHAR)"}
_PROFILE = " UNION ALL ".join(
    f"SELECT load_no, '{c}' AS field_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) - count(nullif(trim(v), '')) AS n_blank, count(DISTINCT v) FILTER (trim(v) <> '') AS n_values, "
    f"min(v) FILTER (trim(v) <> '') AS least, max(v) FILTER (trim(v) <> '') AS greatest, CAST(min(length(v)) FILTER (trim(v) <> '') AS INTEGER) AS shortest, CAST(max(length(v)) FILTER (trim(v) <> '') AS INTEGER) AS longest "
    f"FROM (SELECT *, {v} AS v FROM registry) GROUP BY load_no"
    for c, v in _TEXTS.items()
)
_P3 = f"""
WITH cells AS ({_CELLS}), sized AS (SELECT load_no, f, count(*) AS n FROM cells GROUP BY 1, 2),
m AS (
  SELECT load_no, f, 'blank' AS m, count(*) AS c FROM cells WHERE {_BLANK} GROUP BY 1, 2
  UNION ALL SELECT load_no, f, 'broken', count(*) FROM cells WHERE NOT ({_BLANK}) AND NOT ok GROUP BY 1, 2
  UNION ALL SELECT load_no, f, 'value:' || v, count(*) FROM cells WHERE NOT ({_BLANK}) GROUP BY 1, 2, 3
), kinds AS (SELECT DISTINCT f, m FROM m),
filled AS (
  SELECT sized.load_no, sized.f, kinds.m, coalesce(m.c, 0) / CAST(sized.n AS DOUBLE) AS share
  FROM sized JOIN kinds ON sized.f = kinds.f LEFT JOIN m ON m.load_no = sized.load_no AND m.f = sized.f AND m.m = kinds.m
), usual AS (SELECT f, m, median(share) AS usual FROM filled GROUP BY 1, 2)
SELECT DISTINCT load_no, f AS field_name, row_no FROM cells WHERE NOT ({_BLANK}) AND NOT ok
UNION SELECT filled.load_no, filled.f, 0 FROM filled JOIN usual ON filled.f = usual.f AND filled.m = usual.m WHERE abs(share - usual) > 0.2 + 1e-12
"""


def _us(c: str) -> str:
    t = f"trim({c})"
    return (
        f"coalesce(CAST(epoch_us(TRY_CAST(CASE WHEN regexp_matches({t}, '(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') AND contains({t}, ':') THEN {t} ELSE {t} || 'Z' END AS TIMESTAMPTZ)) AS VARCHAR), {t}, '')"
    )


_P4 = f"""
WITH r AS (
  SELECT snapshot_no AS s, {_canon('iis_no')} AS k, coalesce(TRY_CAST({_us('last_verified')} AS BIGINT), -4611686018427387904) AS lv,
    concat_ws('|', {', '.join(f"coalesce(trim({c}), '')" for c in s.REGISTRY_FIELDS)}, {', '.join(_us(c) for c in s.REGISTRY_TIMES)}) AS body
  FROM registry_snapshots
), one AS (SELECT s, k, arg_max(body, lv) AS body FROM r WHERE k IS NOT NULL GROUP BY 1, 2),
nums AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT snapshot_no AS s FROM registry_snapshots)),
n AS (SELECT one.s, k, body FROM one JOIN nums ON nums.s = one.s WHERE before IS NOT NULL),
o AS (SELECT nums.s, k, body FROM one JOIN nums ON nums.before = one.s),
found AS (
  SELECT coalesce(n.s, o.s) AS snapshot_no, coalesce(n.k, o.k) AS iis_no,
    CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN n.body <> o.body THEN 'changed' END AS change_kind
  FROM n FULL JOIN o ON n.s = o.s AND n.k = o.k
)
"""

SQL = {
    "p1_found": _P1 + "SELECT src_table, ref_month, ref_key FROM found",
    "p1_report": _P1 + "SELECT src_table, ref_month, reason, count(*) AS n_references FROM found GROUP BY 1, 2, 3",
    "p1_filter": _P1 + "SELECT src_table, count(*) AS n_references, count(*) FILTER (reason = 'missing') AS n_missing, true AS mostly_proved FROM judged GROUP BY 1",
    "p3_found": _P3,
    "p3_profile": _PROFILE,
    "p3_coverage": _COVERAGE,
    "p4_found": _P4 + "SELECT snapshot_no, iis_no, change_kind FROM found WHERE change_kind IS NOT NULL",
    "p4_counts": _P4 + "SELECT snapshot_no, change_kind, count(*) AS n_records FROM found WHERE change_kind IS NOT NULL GROUP BY 1, 2",
}
