"""Queries of what a service composes of several operators: resolution by code, the pre-flight of sealing, a document against an expected number, amounts over two lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import integrity as i, registry as r, spatial as s, tokens as k
from attesta.plans import page_ops as p, registry_ops as o, text_ops as x
from attesta.sources.tables import table


def ref_s8_resolution(spark, d):
    """The record that each registry row's code leads to; codes of others, without an answer, or none at all among them."""
    pages = x.verification_pages(spark, d).withColumn("doc_id", F.concat_ws("/", "load_no", "row_no"))
    n = F.col("row_no") % 6
    good = F.concat(F.lit("https://registry.example/verify?q="), F.col("doc_id"))
    url = F.when(n == 0, good).when(n == 1, F.concat(F.lit("http://REGISTRY.example/"), F.col("doc_id"))).when(n == 2, F.concat(F.lit("https://registry.example@evil.example/"), F.col("doc_id"))).when(n == 4, F.concat(F.lit("https://registry.example/gone/"), F.col("doc_id"))).when(n == 5, good)
    each = pages.select("doc_id", "page", url.alias("url"), n.alias("n"))
    codes = each.select("doc_id", F.lit(2).alias("page_no"), F.lit(1).alias("seq"), "url").unionByName(each.select("doc_id", F.lit(3).alias("page_no"), F.lit(0).alias("seq"), F.lit("https://elsewhere.example/").alias("url")).filter("doc_id IS NOT NULL"))
    codes = codes.join(each.filter("n <> 3").select("doc_id").distinct(), "doc_id", "left_semi")
    answers = each.filter("n <> 4").select("url", F.col("page").alias("page_text")).filter("url IS NOT NULL")
    got = r.qr_resolutions(each.select("doc_id"), codes, answers, x.BASE)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return got.select("doc_id", "ok", none("reason"), none("iis_no"), none("url"), F.coalesce("page_no", F.lit(0)).alias("page_no"))


def ref_seal_fit_report(spark, d):
    """The pre-flight for each supplier's pages, with numbers in the text, behind the code, or nowhere."""
    fits = s.document_fit(s.seal_fit(p.boxes(spark, d), p.page_sizes(spark, d)))
    b = p.part_boxes(spark, d)
    spots = s.clear_spots(b, b.select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(842.0)))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("n"))
    texts = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("page_no"), F.concat(F.lit("cites R1-2025-"), "n", F.lit(" Control No: R1-2026-"), "n").alias("text"))
    codes = docs.filter("doc_id % 3 = 1").select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("seq"), F.concat(F.lit("https://registry.example/"), "n").alias("url"))
    answers = docs.filter("doc_id % 6 = 1").select(F.concat(F.lit("https://registry.example/"), "n").alias("url"), F.concat(F.lit("IIS No: R1-2027-"), "n").alias("page_text"))
    found = i.seal_fit_report(fits, spots.withColumn("doc_id", F.col("doc_id").cast("bigint")), r.control_numbers(texts), r.qr_resolutions(docs, codes, answers, x.BASE))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return found.select("doc_id", "clear", F.size("ruled").alias("n_ruled"), zero("move_x"), zero("move_y"), text("iis_no"), text("source"), F.array_join("candidates", ",").alias("candidates"), text("lookup_ok"), text("lookup_reason"))


def ref_w1a_expected(spark, d):
    """Documents of which every third is expected to be another one."""
    st = i.page_status(o.tampered(spark, d), x.KEYS)
    expected = st.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 3 == 0, "R1-2026-000000").when(F.col("doc_id") % 3 == 1, "").alias("expected_no"))
    f = i.document_findings(st, expected)[1]
    return f.select("doc_id", F.coalesce("iis_no", F.lit("")).alias("iis_no"), F.coalesce("claimed_pages", F.lit(0)).alias("claimed_pages"), "actual_pages", "n_findings", "status")


def ref_w7_amounts(spark, d):
    """Amounts in words and figures, every other of them broken over two lines, some after a hyphenated word that is none."""
    n = F.col("row_no")
    money = F.format_number((n * 1234 + F.col("load_no")).cast("bigint"), 2)
    text = (
        F.when(n % 4 == 0, F.concat(F.lit("the sum of PE-\nSOS ("), money, F.lit(") only"))).when(n % 4 == 1, F.concat(F.lit("the sum of pesos ("), money, F.lit(") only")))
        .when(n % 4 == 2, F.concat(F.lit("of the MANAGE-\nMENT ("), money, F.lit(") only"))).otherwise(F.concat(F.lit("the sum of PES-\nO  ("), money, F.lit(") only")))
    )
    pages = table(spark, d, "registry").select(F.concat_ws("/", "load_no", "row_no").alias("pair_id"), text.alias("text"))
    return k.page_tokens(pages).filter("cls = 'money'").select("pair_id", "line", "value")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("ref_") and callable(f)}

_FIELD = x._field(f"IIS{x.W}*No[.]?")
_DOC, _N = "load_no || '/' || row_no", "row_no % 6"
_NUM = "num AS (SELECT doc_id, arg_min(iis_no, -c * 1000 + l) AS doc_no FROM cnt GROUP BY 1)"

SQL = {
    "ref_s8_resolution": f"""WITH q AS (SELECT {_DOC} AS doc_id, {_N} AS n, coalesce(regexp_matches({_FIELD}, '^R1-(?:20|21)[0-9][0-9]-[0-9]{{6}}$'), false) AS good, {_FIELD} AS no FROM ({x._PAGE})),
      s AS (SELECT *, CASE WHEN n IN (2, 3) THEN 'no-qr' WHEN n = 4 THEN 'unreachable' WHEN NOT good THEN 'no-record' ELSE '' END AS reason FROM q)
      SELECT doc_id, reason = '' AS ok, reason, CASE WHEN reason = '' THEN no ELSE '' END AS iis_no, CASE WHEN reason <> '' THEN '' WHEN n = 1 THEN 'http://REGISTRY.example/' || doc_id ELSE 'https://registry.example/verify?q=' || doc_id END AS url, CASE WHEN reason = '' THEN 2 ELSE 0 END AS page_no FROM s""",
    "ref_seal_fit_report": f"""WITH f AS ({p.SQL['ref_a13_document_fit']}), m AS ({p.SQL['ref_a14_clear_spot']}), j AS (SELECT f.*, x0, y0, found, printf('%06d', f.doc_id) AS n, f.doc_id % 3 AS k FROM f LEFT JOIN m ON m.doc_id = f.doc_id)
      SELECT CAST(doc_id AS BIGINT) AS doc_id, clear, CASE WHEN ruled = '' THEN 0 ELSE len(string_split(ruled, ',')) END AS n_ruled, CASE WHEN NOT clear AND found THEN x0 ELSE -1.0 END AS move_x, CASE WHEN NOT clear AND found THEN y0 ELSE -1.0 END AS move_y,
        CASE WHEN k = 0 THEN 'R1-2026-' || n WHEN doc_id % 6 = 1 THEN 'R1-2027-' || n ELSE '' END AS iis_no, CASE WHEN k = 0 THEN 'text' WHEN doc_id % 6 = 1 THEN 'iis' ELSE '' END AS source, CASE WHEN k = 0 THEN 'R1-2026-' || n || ',R1-2025-' || n ELSE '' END AS candidates,
        CASE WHEN k = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'true' ELSE 'false' END AS lookup_ok, CASE WHEN k = 0 OR doc_id % 6 = 1 THEN '' WHEN k = 1 THEN 'unreachable' ELSE 'no-qr' END AS lookup_reason FROM j""",
    "ref_w1a_expected": o.SQL["ref_w1_documents"].replace(_NUM, f"num0 AS ({_NUM[8:-1]}), num AS (SELECT a.doc_id, CASE WHEN a.doc_id % 3 = 0 THEN 'R1-2026-000000' ELSE doc_no END AS doc_no FROM (SELECT DISTINCT doc_id FROM st) a LEFT JOIN num0 ON num0.doc_id = a.doc_id)"),
    "ref_w7_amounts": f"SELECT {_DOC} AS pair_id, CASE WHEN row_no % 4 = 1 THEN 1 ELSE 2 END AS line, '₱' || format('{{:,}}.00', CAST(row_no * 1234 + load_no AS BIGINT)) AS value FROM registry WHERE row_no % 4 <> 2",
}
