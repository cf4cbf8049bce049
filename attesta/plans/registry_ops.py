"""Queries of the registry and integrity operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import seals, text as t
from attesta.functions.keys import canonical_no
from attesta.operators import integrity as i, registry as r
from attesta.plans import text_ops as x
from attesta.sources.tables import table

A = ", ".join(r.ATTRIBUTES)
_when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")

# --- inputs: even loads are on file, odd loads come in ------------------------------------------------------------------


def _loads(spark, d, odd):
    return table(spark, d, "registry").filter(F.col("load_no") % 2 == (1 if odd else 0)).withColumn("at", F.col("first_seen"))


def _on_file(spark, d):
    rows = _loads(spark, d, False).withColumn("iis_no", t.js_trim(F.col("iis_no"))).filter("iis_no <> ''")
    return r.keep_last(rows.select("iis_no", "load_no", "row_no", *r.ATTRIBUTES, "source", "first_seen", "last_verified"), ["iis_no"], [F.col("load_no"), F.col("row_no")]).drop("load_no", "row_no")


def _shown(df):
    return df.select("iis_no", *r.ATTRIBUTES, "source", _when("first_seen").alias("first_seen"), _when("last_verified").alias("last_verified"))


_TRIM = f"regexp_replace(coalesce(iis_no, ''), '^{x.W}+|{x.W}+$', '', 'g')"
_FILED = f"""SELECT iis_no, (arg_max(v, o)).* FROM (SELECT {_TRIM} AS iis_no, load_no * 1000000000 + row_no AS o, {{{{{', '.join(f"'{c}': {c}" for c in (*r.ATTRIBUTES, 'source', 'first_seen', 'last_verified'))}}}}} AS v FROM (SELECT * REPLACE (CAST(load_no AS BIGINT) AS load_no) FROM registry WHERE load_no % 2 = {{odd}})) WHERE iis_no <> '' GROUP BY 1"""
_FILED = _FILED.replace("{{", "{").replace("}}", "}").replace("{odd}", "<odd>")
FILED = _FILED.replace("<odd>", "0").replace("(arg_max(v, o)).*", "unnest(arg_max(v, o))")
COMING = _FILED.replace("<odd>", "1").replace("(arg_max(v, o)).*", "unnest(arg_max(v, o))")


def _requests(spark, d):
    return table(spark, d, "verify_log").select(F.col("id").alias("req_id"), "ts", F.col("queried_id").alias("payload"), "path", "client_hint").dropDuplicates(["req_id"])


def _live(spark, d):
    rows = _loads(spark, d, True).withColumn("iis_no", canonical_no(F.col("iis_no"))).filter("iis_no IS NOT NULL")
    return rows.select("iis_no").distinct()


def tampered(spark, d):
    """Documents of four sealed pages made of the corpus, tampered with by their number: (doc_id, position, text)."""
    docs = table(spark, d, "documents").select((F.floor(F.col("doc_id") / 4)).cast("bigint").alias("doc"), (F.col("doc_id") % 4 + 1).cast("int").alias("k"), t.text(F.col("text")).alias("body"))
    how = F.col("doc") % 8
    p = docs.withColumn("no", F.when((how == 3) & (F.col("k") == 2), "R1-2026-999999").otherwise(F.format_string("R1-2026-%06d", F.col("doc")))).withColumn("n", F.when(how == 7, 5).otherwise(4)).withColumn("kid", F.when(F.col("doc") % 11 == 10, "9").otherwise("1"))
    digest = seals.page_digest(t.strip_seal_lines(F.col("body")))
    made = F.coalesce(seals.seal(x.KEYS, F.col("kid"), F.col("no"), F.col("k"), F.col("n"), digest), F.lit("AAAA-AAAA"))
    line = F.when((how == 2) & (F.col("k") == 3), F.lit("")).otherwise(t.seal_line(F.col("no"), F.col("k"), F.col("n"), F.col("kid"), made))
    text = F.concat(F.col("body"), F.when((how == 1) & (F.col("k") == 2), F.lit(" edited")).otherwise(F.lit("")), F.lit("\n"), line)
    position = F.when((how == 4) & (F.col("k") <= 2), 3 - F.col("k")).otherwise(F.col("k"))
    p = p.select(F.col("doc").alias("doc_id"), position.alias("position"), text.alias("text"), "k", how.alias("how"))
    extra = p.filter("how = 5 AND k = 3").withColumn("position", F.lit(5))
    return p.filter("NOT (how = 6 AND k = 4)").unionByName(extra).select("doc_id", "position", "text")


_TAMPERED = f"""
  SELECT doc AS doc_id, CASE WHEN how = 4 AND k <= 2 THEN 3 - k WHEN extra THEN 5 ELSE k END AS position, no, k, n, kid, how = 2 AND k = 3 AS bare,
    body || CASE WHEN how = 1 AND k = 2 THEN ' edited' ELSE '' END AS shown, body, CASE WHEN kid = '1' THEN {x.sql_seal(x.sql_hmac(x.KEYS['1'], "concat_ws('|', no, k, n, sha256(" + x.strip('body') + "))"))} ELSE 'AAAA-AAAA' END AS seal, how
  FROM (SELECT *, doc % 8 AS how, CASE WHEN doc % 8 = 3 AND k = 2 THEN 'R1-2026-999999' ELSE printf('R1-2026-%06d', doc) END AS no, CASE WHEN doc % 8 = 7 THEN 5 ELSE 4 END AS n, CASE WHEN doc % 11 = 10 THEN '9' ELSE '1' END AS kid
    FROM (SELECT doc_id // 4 AS doc, CAST(doc_id % 4 + 1 AS INTEGER) AS k, coalesce(text, '') AS body, unnest(CASE WHEN (doc_id // 4) % 8 = 5 AND doc_id % 4 = 2 THEN [false, true] ELSE [false] END) AS extra FROM documents))
  WHERE NOT (how = 6 AND k = 4)"""
# The words of the corpus hold no seal line of their own, so the printed line is the first one of its page.
_STATUS = f"""SELECT doc_id, position, CASE WHEN NOT bare THEN no END AS iis_no, CASE WHEN NOT bare THEN k END AS claimed_k, CASE WHEN NOT bare THEN n END AS claimed_n, CASE WHEN bare THEN 'not_sealed' WHEN kid = '1' AND {x.canon('shown')} = {x.strip('body')} THEN 'verified' ELSE 'content_altered' END AS status
  FROM ({_TAMPERED})"""
_HEAD = """
  st AS (<status>),
  cnt AS (SELECT doc_id, iis_no, count(*) AS c, max(position) AS l FROM st WHERE status <> 'not_sealed' GROUP BY 1, 2),
  num AS (SELECT doc_id, arg_min(iis_no, -c * 1000 + l) AS doc_no FROM cnt GROUP BY 1),
  cn AS (SELECT st.doc_id, claimed_n, count(*) AS c, max(position) AS l FROM st JOIN num ON num.doc_id = st.doc_id AND st.iis_no = doc_no GROUP BY 1, 2),
  len AS (SELECT doc_id, arg_min(claimed_n, -c * 1000 + l) AS doc_n FROM cn GROUP BY 1),
  head AS (SELECT s.doc_id, doc_no, doc_n, actual, sealed FROM (SELECT doc_id, count(*) AS actual, count(*) FILTER (status <> 'not_sealed') AS sealed FROM st GROUP BY 1) s LEFT JOIN num ON num.doc_id = s.doc_id LEFT JOIN len ON len.doc_id = s.doc_id),
  p AS (SELECT st.*, doc_no, CASE WHEN status <> 'not_sealed' THEN row_number() OVER (PARTITION BY st.doc_id, claimed_k ORDER BY position) END AS nth FROM st JOIN head ON head.doc_id = st.doc_id),
  f AS (
    SELECT doc_id, 1 AS phase, position, 0 AS rule, 'Page at position ' || position || ' carries no seal (inserted or unsealed).' AS finding FROM p WHERE status = 'not_sealed'
    UNION ALL SELECT doc_id, 1, position, 1, 'Page ' || position || ' belongs to a different document (' || iis_no || ').' FROM p WHERE status <> 'not_sealed' AND iis_no <> doc_no
    UNION ALL SELECT doc_id, 1, position, 2, 'Page ' || position || ' (page ' || claimed_k || ') content was altered.' FROM p WHERE status = 'content_altered'
    UNION ALL SELECT doc_id, 1, position, 3, 'Page ' || position || ' is out of order (claims to be page ' || claimed_k || ').' FROM p WHERE status <> 'not_sealed' AND claimed_k <> position
    UNION ALL SELECT doc_id, 1, position, 4, 'Page ' || claimed_k || ' is duplicated.' FROM p WHERE nth > 1
    UNION ALL SELECT h.doc_id, 2, h.k, 5, 'Page ' || h.k || ' of ' || doc_n || ' is missing.' FROM (SELECT doc_id, doc_n, unnest(range(1, doc_n + 1)) AS k FROM head WHERE doc_n >= 1) h
      WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = h.doc_id AND st.claimed_k = h.k)
    UNION ALL SELECT doc_id, 3, 0, 6, 'Document should have ' || doc_n || ' pages but has ' || actual || '.' FROM head WHERE doc_n <> actual)
""".replace("<status>", _STATUS)

# --- queries ----------------------------------------------------------------------------------------------------------


def ref_q1_schemas(spark, d):
    rows = [(n, f.name, f.dataType.simpleString()) for n, s in (("documents", r.DOCUMENTS), ("verify_log", r.VERIFY_LOG), ("pages", r.PAGES)) for f in s.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def ref_s1_cells(spark, d):
    g = table(spark, d, "registry")
    return g.select("load_no", "row_no", r.cell_text(F.col("subject_name"), F.col("attachment_ref")).alias("cell"), r.cell_link(F.col("subject_name"), F.col("attachment_ref")).alias("link"))


def ref_q2_upsert(spark, d):
    return _shown(r.merge_batch(_on_file(spark, d), _loads(spark, d, True), [F.col("at"), *[F.coalesce(F.col(c), F.lit("")) for c in r.ATTRIBUTES]]))


def ref_q5_live_upsert(spark, d):
    return _shown(r.merge_batch(_on_file(spark, d), _loads(spark, d, True), [F.col("at"), *[F.coalesce(F.col(c), F.lit("")) for c in r.ATTRIBUTES]], live=True))


def ref_a1_ingest_metrics(spark, d):
    return r.ingest_metrics(_loads(spark, d, True), _on_file(spark, d))


def ref_q4_lookup(spark, d):
    n = _requests(spark, d).select("req_id", t.normalize_id(F.col("payload"))["lookup_key"].alias("lookup_key"))
    return r.lookup(n, _on_file(spark, d)).filter("hit IS NOT NULL").select("req_id", F.col("lookup_key").alias("iis_no"), "hit.subject_name", "hit.company_name")


def ref_f1_verify(spark, d):
    return r.verify(_requests(spark, d), _on_file(spark, d), _live(spark, d)).drop("ts")


def ref_t2_backfill(spark, d):
    return r.backfill(_requests(spark, d), _on_file(spark, d), _live(spark, d)).drop("ts")


def ref_a2_mode(spark, d):
    e = table(spark, d, "verify_log").dropDuplicates(["id"]).filter("queried_id IS NOT NULL")
    return r.first_reached_mode(e, ["queried_id"], "outcome", ["ts", "id"])


def ref_q8_page_list(spark, d):
    return r.page_list(_pages(spark, d))


def _pages(spark, d):
    p = table(spark, d, "pages").withColumn("iis_no", canonical_no(F.col("iis_no"))).filter("iis_no IS NOT NULL")
    return r.upsert_pages(p, [F.col("created_at"), F.col("seal"), F.coalesce("sealed_pdf_path", F.lit(""))])


def ref_q9_upsert_pages(spark, d):
    return _pages(spark, d).withColumn("created_at", _when("created_at"))


def control_pages(spark, d):
    p = table(spark, d, "pages").select(canonical_no(F.col("iis_no")).alias("no"), "page_no").filter("no IS NOT NULL").distinct()
    text = F.when(F.col("page_no") % 3 == 1, F.concat(F.lit("Control No: "), "no", F.lit(" cites R1-2020-000001 here"))).when(F.col("page_no") % 3 == 2, F.concat(F.lit("see R1-2020-000001 and x"), "no", F.lit(" or "), "no", F.lit("."))).otherwise(F.concat(F.lit("CONTROL NUMBER "), "no", F.lit(" of many , then "), "no"))
    return p.select(F.col("no").alias("doc_id"), "page_no", text.alias("text"))


def ref_p2_control_numbers(spark, d):
    return r.control_numbers(control_pages(spark, d)).select("doc_id", "iis_no", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "labelled", F.col("rank").cast("bigint").alias("rank"))


def ref_p27_evidence(spark, d):
    c = r.control_numbers(control_pages(spark, d)).filter("rank = 1")
    return c.select("doc_id", t.candidate_evidence(F.col("pages"), F.col("labelled")).alias("evidence"))


def page_requests(spark, d):
    p = table(spark, d, "pages").select(canonical_no(F.col("iis_no")).alias("iis_no"), F.col("page_no").alias("k"), "total_pages", "seal").filter("iis_no IS NOT NULL").distinct()
    how = F.pmod(F.xxhash64("iis_no"), F.lit(1)) + F.substring("iis_no", -2, 2).cast("int") % 6
    return p.select(F.concat_ws("/", "iis_no", F.col("k").cast("string"), "seal").alias("req_id"), F.when(how == 1, "").otherwise(F.col("iis_no")).alias("iis_no"), F.when(how == 2, F.col("k") + 100).otherwise(F.col("k")).alias("k"), F.when(how == 3, F.col("total_pages") + 1).when(how == 4, F.col("total_pages")).alias("n"), F.when(how == 5, "AAAA-AAAA").otherwise(F.col("seal")).alias("seal"))


def _sealed_pages(spark, d):
    """The pages on file, every other number sealed anew under the test key, so that genuine seals occur."""
    p = _pages(spark, d)
    even = F.substring("iis_no", -1, 1).cast("int") % 2 == 0
    return p.withColumn("kid", F.when(even, "1").otherwise(F.when(F.col("page_no") % 2 == 0, F.lit("7")).otherwise(F.lit("2")))).withColumn("seal", F.when(even, seals.seal(x.KEYS, F.lit("1"), F.col("iis_no"), F.col("page_no"), F.col("total_pages"), F.col("digest"))).otherwise(F.col("seal")))


def ref_f2_page_verdicts(spark, d):
    pages = _sealed_pages(spark, d)
    made = pages.select(F.concat_ws("/", "iis_no", F.col("page_no").cast("string")).alias("req_id"), "iis_no", F.col("page_no").alias("k"), F.lit(None).cast("int").alias("n"), "seal")
    v = i.page_verdicts(page_requests(spark, d).unionByName(made), pages, x.KEYS)
    return v.select("req_id", F.col("iis_no").alias("no"), F.col("k").cast("string").alias("k"), "status")


def ref_f3_page_status(spark, d):
    return i.page_status(tampered(spark, d), x.KEYS).select("doc_id", "position", F.coalesce("iis_no", F.lit("")).alias("iis_no"), F.coalesce("claimed_k", F.lit(0)).alias("claimed_k"), "status")


def ref_w1_findings(spark, d):
    return i.document_findings(i.page_status(tampered(spark, d), x.KEYS))[0]


def ref_w1_documents(spark, d):
    f = i.document_findings(i.page_status(tampered(spark, d), x.KEYS))[1]
    return f.select("doc_id", F.coalesce("iis_no", F.lit("")).alias("iis_no"), F.coalesce("claimed_pages", F.lit(0)).alias("claimed_pages"), "actual_pages", "n_findings", "status")


def ref_o7_missing_pages(spark, d):
    return ref_w1_findings(spark, d).filter("rule = 5").select("doc_id", F.col("position").alias("missing"))


def ref_p31_document_report(spark, d):
    st = i.page_status(tampered(spark, d), x.KEYS)
    return i.document_report(st, i.document_findings(st)[1])


def ref_p32_page_states(spark, d):
    label = F.create_map(*[F.lit(v) for p in i.PAGE_STATES.items() for v in p])
    return ref_f2_page_verdicts(spark, d).groupBy("status").agg(F.count("*").alias("n")).withColumn("stamp", F.coalesce(label[F.col("status")], F.lit("Unknown key")))


def ref_s4_single_page(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("doc"), (F.col("doc_id") % 4 + 1).alias("page_no"), t.canonicalize(F.col("text")).alias("text")).filter("page_no = 2").select("doc", "text")


def ref_seal_pages(spark, d):
    """POST /api/seal as a table function: the corpus as documents of up to four pages, sealed."""
    docs = table(spark, d, "documents")
    pages = docs.select(F.format_string("R1-2026-%06d", F.floor(F.col("doc_id") / 4).cast("bigint")).alias("iis_no"), (F.col("doc_id") % 4 + 1).cast("int").alias("page_no"), "text")
    return i.sealed_pages(pages, x.KEYS, "1").select("iis_no", "page_no", F.col("total_pages").cast("bigint").alias("total_pages"), "digest", "seal", "footer", "payload")


def seal_requests(spark, d):
    g, n = table(spark, d, "registry"), F.col("row_no")
    at = F.when(n % 5 == 0, F.concat(F.lit('{"x0": '), n.cast("string"), F.lit(', "y0": 30.5}'))).when(n % 5 == 1, "not json").when(n % 5 == 2, '{"x0": 1}').when(n % 5 == 3, "")
    return g.select(F.concat_ws("/", "load_no", "row_no").alias("req_id"), (n % 11 != 0).alias("has_file"), "iis_no", at.alias("at"))


def ref_f8_seal_requests(spark, d):
    v = i.seal_request_errors(seal_requests(spark, d))
    return v.select("req_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("x0", F.lit(-1.0)).alias("x0"), F.coalesce("y0", F.lit(-1.0)).alias("y0"))


def ref_f8_image_requests(spark, d):
    g, n = table(spark, d, "registry"), F.col("row_no")
    k = F.when(n % 6 == 0, "0").when(n % 6 == 1, "x").when(n % 6 == 2, "3").when(n % 6 == 3, "2.5").when(n % 6 == 4, "-1")
    req = g.select(F.concat_ws("/", "load_no", "row_no").alias("req_id"), (n % 11 != 0).alias("has_file"), F.col("iis_no").alias("doc"), k.alias("k"))
    return i.image_request_errors(req).select("req_id", F.coalesce("error", F.lit("")).alias("error"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("ref_") and callable(f)}

# --- SQL --------------------------------------------------------------------------------------------------------------

_T = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')".format
_UPS = f"""
  WITH f AS ({FILED}), b AS (SELECT {_TRIM} AS iis_no, {A}, first_seen AS at_ts FROM registry WHERE load_no % 2 = 1),
  n AS (SELECT iis_no, min(at_ts) AS first_ts, max(at_ts) AS at_ts, max({{k: at_ts, {', '.join(f"x{j}: coalesce({c}, '')" for j, c in enumerate(r.ATTRIBUTES))}, {', '.join(f'{c}: {c}' for c in r.ATTRIBUTES)}}}) AS v FROM b WHERE iis_no <> '' GROUP BY 1)
  SELECT coalesce(n.iis_no, f.iis_no) AS iis_no, {', '.join(f'CASE WHEN n.iis_no IS NOT NULL THEN v.{c} ELSE f.{c} END AS {c}' for c in r.ATTRIBUTES)},
    <source> AS source, {_T('CASE WHEN f.iis_no IS NOT NULL THEN first_seen ELSE first_ts END')} AS first_seen, {_T('<verified>')} AS last_verified FROM f FULL JOIN n ON f.iis_no = n.iis_no"""
_REQ = "SELECT DISTINCT ON (id) id, ts, queried_id AS payload, path, client_hint FROM verify_log"
_V = f"""
  WITH f AS ({FILED}), q AS ({_REQ}), live AS (SELECT DISTINCT nullif(regexp_extract(upper(iis_no), 'R1-[0-9]{{4}}-[0-9]{{4,}}', 0), '') AS k FROM registry WHERE load_no % 2 = 1),
  v AS (SELECT q.id AS req_id, q.ts, coalesce(payload, '') AS queried_id, n.canonical_id AS k, kind, path, client_hint, f.iis_no IS NOT NULL AND kind <> 'unknown' AS hit, live.k IS NOT NULL AND path = 'staff' AND kind <> 'unknown' AND f.iis_no IS NULL AS lively
    FROM q JOIN ({x._NORM.replace('<source>', 'SELECT id, payload FROM q')}) n ON n.id = q.id LEFT JOIN f ON f.iis_no = n.canonical_id LEFT JOIN live ON live.k = n.canonical_id),
  o AS (SELECT req_id, ts, queried_id, k, CASE WHEN hit OR lively THEN k END AS resolved_iis_no, CASE WHEN kind = 'unknown' THEN 'invalid' WHEN hit THEN 'verified_local' WHEN lively THEN 'verified_live' WHEN path = 'staff' THEN 'not_found' ELSE 'needs_staff' END AS status,
    CASE WHEN hit THEN 'local_hit' WHEN lively THEN 'iis_hit' ELSE 'not_found' END AS outcome, path, client_hint FROM v)"""
_PG = """SELECT iis_no, page_no, unnest(max({c: created_at, s: seal, q: coalesce(sealed_pdf_path, ''), total_pages: total_pages, digest: digest, kid: kid, sealed_pdf_path: sealed_pdf_path})) FROM (SELECT * REPLACE (nullif(regexp_extract(upper(iis_no), 'R1-[0-9]{4}-[0-9]{4,}', 0), '') AS iis_no) FROM pages) WHERE iis_no IS NOT NULL GROUP BY 1, 2"""
_CTL = """
  WITH p AS (SELECT DISTINCT nullif(regexp_extract(upper(iis_no), 'R1-[0-9]{4}-[0-9]{4,}', 0), '') AS no, page_no FROM pages), o AS (SELECT no, 'R1-2020-000001' AS other, page_no FROM p WHERE no IS NOT NULL),
  e AS (SELECT no AS doc_id, no AS iis_no, page_no, page_no % 3 IN (0, 1) AS labelled, CASE page_no % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS pos FROM o
    UNION ALL SELECT no, other, page_no, false, CASE page_no % 3 WHEN 1 THEN 1 ELSE 0 END FROM o WHERE page_no % 3 IN (1, 2)),
  g AS (SELECT doc_id, iis_no, bool_or(labelled) AS labelled, list_sort(list_distinct(list(page_no))) AS pages, min(page_no * 10 + pos) AS seen FROM e GROUP BY 1, 2),
  c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled DESC, len(pages) DESC, seen) AS rank FROM g)"""
_SP = f"""
  pg0 AS ({_PG}), pg AS (SELECT iis_no, page_no, total_pages, digest, CASE WHEN even THEN '1' WHEN page_no % 2 = 0 THEN '7' ELSE '2' END AS kid, CASE WHEN even THEN {x.sql_seal('h')} ELSE s END AS seal
    FROM (SELECT *, CAST(right(iis_no, 1) AS INTEGER) % 2 = 0 AS even, {x.sql_hmac(x.KEYS['1'], "concat_ws('|', iis_no, page_no, total_pages, digest)")} AS h FROM pg0)),
  rq AS (SELECT concat_ws('/', no, k, seal) AS req_id, CASE WHEN how = 1 THEN '' ELSE no END AS no, CASE WHEN how = 2 THEN k + 100 ELSE k END AS k, CASE WHEN how = 3 THEN total_pages + 1 WHEN how = 4 THEN total_pages END AS n, CASE WHEN how = 5 THEN 'AAAA-AAAA' ELSE seal END AS seal
    FROM (SELECT *, CAST(right(no, 2) AS INTEGER) % 6 AS how FROM (SELECT DISTINCT nullif(regexp_extract(upper(iis_no), 'R1-[0-9]{{4}}-[0-9]{{4,}}', 0), '') AS no, page_no AS k, total_pages, seal FROM pages) WHERE no IS NOT NULL)
    UNION ALL SELECT concat_ws('/', iis_no, page_no), iis_no, page_no, NULL, seal FROM pg),
  fv AS (SELECT req_id, rq.no, CAST(rq.k AS VARCHAR) AS k, CASE WHEN coalesce(rq.seal, '') = '' OR rq.no = '' OR rq.k IS NULL THEN 'invalid_code' WHEN pg.iis_no IS NULL THEN 'not_sealed' WHEN rq.n <> pg.total_pages THEN 'page_count_mismatch' WHEN pg.kid = '7' THEN 'unknown_key'
      WHEN pg.seal = rq.seal AND CASE pg.kid WHEN '1' THEN {x.sql_seal(x.sql_hmac(x.KEYS['1'], 'm'))} ELSE {x.sql_seal(x.sql_hmac(x.KEYS['2'], 'm'))} END = rq.seal THEN 'page_verified' ELSE 'invalid_seal' END AS status
    FROM rq LEFT JOIN (SELECT *, concat_ws('|', iis_no, page_no, total_pages, digest) AS m FROM pg) pg ON pg.iis_no = rq.no AND pg.page_no = rq.k)"""
_STAMP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in i.PAGE_STATES.items())
_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in i.PAGE_LABELS.items())

SQL = {
    "ref_q1_schemas": " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type" for n, s in (("documents", r.DOCUMENTS), ("verify_log", r.VERIFY_LOG), ("pages", r.PAGES)) for f in s.fields),
    "ref_s1_cells": "SELECT load_no, row_no, coalesce(subject_name, attachment_ref, '') AS cell, coalesce(attachment_ref, subject_name, '') AS link FROM registry",
    "ref_q2_upsert": _UPS.replace("<source>", "coalesce(source, 'excel')").replace("<verified>", "last_verified"),
    "ref_q5_live_upsert": _UPS.replace("<source>", "CASE WHEN n.iis_no IS NOT NULL THEN 'iis_live' ELSE source END").replace("<verified>", "CASE WHEN n.iis_no IS NOT NULL THEN at_ts ELSE last_verified END"),
    "ref_a1_ingest_metrics": f"""WITH f AS ({FILED}), b AS (SELECT {_TRIM} AS iis_no FROM registry WHERE load_no % 2 = 1), k AS (SELECT iis_no, count(*) AS n FROM b WHERE iis_no <> '' GROUP BY 1)
      SELECT CAST(count(*) FILTER (f.iis_no IS NULL) AS BIGINT) AS inserted, CAST(sum(n) - count(*) FILTER (f.iis_no IS NULL) AS BIGINT) AS updated, CAST(sum(n) AS BIGINT) AS total FROM k LEFT JOIN f ON f.iis_no = k.iis_no""",
    "ref_q4_lookup": _V + " SELECT o.req_id, k AS iis_no, f.subject_name, f.company_name FROM o JOIN f ON f.iis_no = o.k WHERE NOT (k = '')",
    "ref_f1_verify": _V + " SELECT req_id, queried_id, resolved_iis_no, status, outcome, path, client_hint FROM o",
    "ref_t2_backfill": _V + """, s AS (SELECT k, min({t: ts, i: req_id}) AS since FROM o WHERE status = 'verified_live' GROUP BY 1), j AS (SELECT o.*, since IS NOT NULL AND {t: ts, i: req_id} > since AND status IN ('verified_live', 'needs_staff', 'not_found') AS later FROM o LEFT JOIN s ON s.k = o.k)
      SELECT req_id, queried_id, CASE WHEN later THEN k ELSE resolved_iis_no END AS resolved_iis_no, CASE WHEN later THEN 'verified_local' ELSE status END AS status, CASE WHEN later THEN 'local_hit' ELSE outcome END AS outcome, path, client_hint FROM j""",
    "ref_a2_mode": """WITH e AS (SELECT DISTINCT ON (id) id, ts, queried_id, outcome FROM verify_log WHERE queried_id IS NOT NULL), g AS (SELECT queried_id, outcome, count(*) AS n, max({t: ts, i: id}) AS l FROM e GROUP BY 1, 2)
      SELECT queried_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY queried_id ORDER BY n DESC, l) AS rn FROM g) WHERE rn = 1""",
    "ref_q8_page_list": f"""WITH p AS ({_PG}) SELECT iis_no, first_value(total_pages) OVER (PARTITION BY iis_no ORDER BY page_no) AS total, page_no AS k, total_pages AS n, s AS seal, kid,
      concat_ws(' · ', 'EMB', iis_no, 'p' || page_no || '/' || total_pages, 'K' || kid, s) AS footer, coalesce(sealed_pdf_path, '') <> '' AS has_image FROM p""",
    "ref_q9_upsert_pages": f"SELECT iis_no, page_no, total_pages, digest, s AS seal, kid, sealed_pdf_path, {_T('c')} AS created_at FROM ({_PG})",
    "ref_p2_control_numbers": _CTL + " SELECT doc_id, iis_no, array_to_string(pages, ',') AS pages, labelled, rank FROM c",
    "ref_p27_evidence": _CTL + " SELECT doc_id, 'Found on ' || CASE len(pages) WHEN 1 THEN 'page ' || pages[1] WHEN 2 THEN 'pages ' || pages[1] || ' and ' || pages[2] ELSE 'all ' || len(pages) || ' pages' END || ', ' || CASE WHEN labelled THEN 'labelled “Control No.”' ELSE 'unlabelled' END || '.' AS evidence FROM c WHERE rank = 1",
    "ref_f2_page_verdicts": f"WITH {_SP} SELECT * FROM fv",
    "ref_p32_page_states": f"WITH {_SP} SELECT status, count(*) AS n, CASE status {_STAMP} ELSE 'Unknown key' END AS stamp FROM fv GROUP BY 1",
    "ref_f3_page_status": f"SELECT doc_id, position, coalesce(iis_no, '') AS iis_no, coalesce(claimed_k, 0) AS claimed_k, status FROM ({_STATUS})",
    "ref_w1_findings": f"WITH {_HEAD} SELECT * FROM f",
    "ref_o7_missing_pages": f"WITH {_HEAD} SELECT doc_id, position AS missing FROM f WHERE rule = 5",
    "ref_w1_documents": f"WITH {_HEAD} SELECT head.doc_id, coalesce(doc_no, '') AS iis_no, coalesce(doc_n, 0) AS claimed_pages, actual AS actual_pages, coalesce(c, 0) AS n_findings, CASE WHEN coalesce(c, 0) = 0 AND sealed = actual THEN 'intact' ELSE 'tampered' END AS status FROM head LEFT JOIN (SELECT doc_id, count(*) AS c FROM f GROUP BY 1) q ON q.doc_id = head.doc_id",
    "ref_p31_document_report": f"""WITH {_HEAD} SELECT st.doc_id, position, CASE status {_LABEL} END AS label, CASE WHEN q.doc_id IS NULL AND sealed = actual THEN 'Intact' ELSE 'Tampered' END AS stamp, actual || ' of ' || coalesce(CAST(doc_n AS VARCHAR), '?') || ' pages' AS extent
      FROM st JOIN head ON head.doc_id = st.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM f) q ON q.doc_id = st.doc_id""",
    "ref_s4_single_page": f"SELECT doc_id // 4 AS doc, {x.canon('text')} AS text FROM documents WHERE doc_id % 4 = 1",
    "ref_seal_pages": f"""WITH p AS (SELECT printf('R1-2026-%06d', doc_id // 4) AS iis_no, CAST(doc_id % 4 + 1 AS INTEGER) AS page_no, sha256({x.strip('text')}) AS digest, count(*) OVER (PARTITION BY doc_id // 4) AS total_pages FROM documents),
      s AS (SELECT *, {x.sql_seal(x.sql_hmac(x.KEYS['1'], "concat_ws('|', iis_no, page_no, total_pages, digest)"))} AS seal FROM p)
      SELECT iis_no, page_no, total_pages, digest, seal, concat_ws(' · ', 'EMB', iis_no, 'p' || page_no || '/' || total_pages, 'K1', seal) AS footer, concat_ws('|', 'CVR', iis_no, page_no, seal) AS payload FROM s""",
    "ref_f8_seal_requests": """SELECT load_no || '/' || row_no AS req_id, e AS error, CASE WHEN e = '' AND row_no % 5 = 0 THEN CAST(row_no AS DOUBLE) ELSE -1.0 END AS x0, CASE WHEN e = '' AND row_no % 5 = 0 THEN CAST(30.5 AS DOUBLE) ELSE -1.0 END AS y0
      FROM (SELECT *, CASE WHEN row_no % 11 = 0 THEN 'No file uploaded.' WHEN coalesce(trim(iis_no), '') = '' THEN 'iisNo is required.' WHEN row_no % 5 = 1 THEN 'Bad seal position.' ELSE '' END AS e FROM registry)""",
    "ref_f8_image_requests": "SELECT load_no || '/' || row_no AS req_id, CASE WHEN row_no % 11 = 0 THEN 'No image uploaded.' WHEN coalesce(trim(iis_no), '') = '' OR row_no % 6 NOT IN (2, 3) THEN 'Need the control number and page number.' ELSE '' END AS error FROM registry",
}
