"""Queries of the scalar text operators (P1-P33) and of the seals (K1-K5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.functions import seals, text as t
from attesta.functions.keys import canonical_no
from attesta.sources.tables import table

# The key of tests; no secret.
KEYS = {"1": "test-secret", "2": "another-test-secret"}
BASE = "https://registry.example"

# --- inputs -----------------------------------------------------------------------------------------------------------


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """What was asked for in the log: as it is, as a link, or as a link with the number in its query."""
    q = F.coalesce(F.col("queried_id"), F.lit(""))
    shape = F.col("id") % 4
    link = F.when(shape == 0, F.concat(F.lit("https://registry.example/view/"), q, F.lit("?x=1#top"))).when(shape == 1, F.concat(F.lit("HTTP://registry.example/?q="), q)).otherwise(q)
    return table(spark, d, "verify_log").select("id", link.alias("payload")).distinct()


SQL_PAYLOADS = """
  SELECT DISTINCT id, CASE WHEN id % 4 = 0 THEN 'https://registry.example/view/' || coalesce(queried_id, '') || '?x=1#top'
    WHEN id % 4 = 1 THEN 'HTTP://registry.example/?q=' || coalesce(queried_id, '') ELSE coalesce(queried_id, '') END AS payload FROM verify_log"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Printed seal lines of the registered pages, some worn: other spacing, lower case, cut off."""
    p = table(spark, d, "pages").select(canonical_no(F.col("iis_no")).alias("no"), "page_no", "total_pages", "kid", "seal").filter("no IS NOT NULL").distinct()
    line = t.seal_line(F.col("no"), F.col("page_no"), F.col("total_pages"), F.col("kid"), F.col("seal"))
    worn = F.when(F.col("page_no") % 5 == 1, F.concat(F.lit("Printed:  "), F.replace(line, F.lit(" · "), F.lit("  ·  ")))).when(F.col("page_no") % 5 == 2, F.lower(line)).when(F.col("page_no") % 5 == 3, F.regexp_replace(line, " · K.*", "")).otherwise(line)
    return p.withColumn("line", worn)


SQL_LINES = """
  SELECT *, CASE page_no % 5 WHEN 1 THEN 'Printed:  ' || replace(l, ' · ', '  ·  ') WHEN 2 THEN lower(l) WHEN 3 THEN regexp_replace(l, ' · K.*', '') ELSE l END AS line
  FROM (SELECT *, concat_ws(' · ', 'EMB', no, 'p' || page_no || '/' || total_pages, 'K' || kid, seal) AS l FROM (
    SELECT DISTINCT nullif(regexp_extract(upper(iis_no), 'R1-[0-9]{4}-[0-9]{4,}', 0), '') AS no, page_no, total_pages, kid, seal FROM pages) WHERE no IS NOT NULL)"""

W = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LINE = rf"EMB{W}*·{W}*([A-Z0-9-]+){W}*·{W}*p([0-9]+)/([0-9]+){W}*·{W}*K([0-9A-Za-z]+){W}*·{W}*([0-9A-Z]{{4}}-[0-9A-Z]{{4}})"


def canon(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{W}+', ' ', 'g'))"


def strip(c: str) -> str:
    return canon(f"regexp_replace(coalesce({c}, ''), '{LINE}', ' ', 'g')")


def fold(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{t.GLYPHS[0]}', '{t.GLYPHS[1]}')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as page texts; every third page carries a seal line."""
    line = F.lit(" EMB · R1-2026-000001 · p1/3 · K1 · W5FB-P5CD ")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), line)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", body.alias("body"))


SQL_DOCS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' EMB · R1-2026-000001 · p1/3 · K1 · W5FB-P5CD ' ELSE text END AS body FROM documents"

# --- queries ----------------------------------------------------------------------------------------------------------


def ref_p1_normalize(spark, d):
    return payloads(spark, d).select("id", t.normalize_id(F.col("payload")).alias("n")).select("id", "n.kind", "n.canonical_id")


def ref_p3_live_record(spark, d):
    """The page is the client's hint with the number asked for; every seventh says that nothing was found."""
    page = F.when(F.col("id") % 7 == 0, F.lit("No  record")).otherwise(F.concat(F.lit("Result for "), F.coalesce("queried_id", F.lit("")), F.lit(" : shown")))
    n = t.normalize_id(F.col("queried_id"))
    return table(spark, d, "verify_log").select("id", t.live_record_no(page, n["kind"], n["canonical_id"]).alias("iis_no")).distinct()


def ref_p4_lookup_url(spark, d):
    n = t.normalize_id(F.col("payload"))
    return payloads(spark, d).select("id", t.lookup_url(n["kind"], n["canonical_id"], F.lit(BASE)).alias("url"))


def verification_pages(spark, d):
    r = table(spark, d, "registry").select("load_no", "row_no", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("iis_no", "subject_name", "company_name", "transaction_type")])
    page = F.concat(F.lit("Verification\n IIS No. : "), "iis_no", F.lit("\nSubject: "), F.concat(F.col("subject_name"), F.lit(".")), F.lit("\n status :"), F.col("transaction_type"), F.lit(".  \nCompany  Name : "), F.col("company_name"), F.lit("!"))
    return r.select("load_no", "row_no", page.alias("page"))


def ref_p5_verification_page(spark, d):
    return verification_pages(spark, d).select("load_no", "row_no", t.parse_verification_page(F.col("page")).alias("v")).filter("v IS NOT NULL").select("load_no", "row_no", "v.*")


def ref_p6_may_fetch(spark, d):
    who = F.when(F.col("id") % 6 == 0, "https://registry.example/verify?q=").when(F.col("id") % 6 == 1, "http://REGISTRY.example/").when(F.col("id") % 6 == 2, "https://registry.example@evil.example/").when(F.col("id") % 6 == 3, "ftp://registry.example/").when(F.col("id") % 6 == 4, "https://registry.example.evil/").otherwise("")
    return table(spark, d, "verify_log").select("id", t.may_fetch(F.concat(who, F.col("id").cast("string")), F.lit(BASE)).alias("ok")).distinct()


def ref_p7_canonicalize(spark, d):
    return docs(spark, d).select("doc_id", t.canonicalize(F.col("body")).alias("canonical"))


def ref_p8_strip_seal_lines(spark, d):
    return docs(spark, d).select("doc_id", t.strip_seal_lines(F.col("body")).alias("stripped"))


def ref_p9_parse_seal_line(spark, d):
    return lines(spark, d).select("line", t.parse_seal_line(F.col("line")).alias("p")).filter("p IS NOT NULL").select("line", "p.*").distinct()


def ref_p10_parse_payload(spark, d):
    made = lines(spark, d).select(F.when(F.col("page_no") % 3 == 0, F.lower(t.payload(F.col("no"), F.col("page_no"), F.col("seal")))).when(F.col("page_no") % 3 == 1, t.payload(F.col("no"), F.col("page_no"), F.col("seal"))).otherwise(F.concat(F.lit(" "), t.payload(F.col("no"), F.col("page_no"), F.col("seal")))).alias("code"))
    return made.select("code", t.parse_payload(F.col("code")).alias("p")).filter("p IS NOT NULL").select("code", "p.iis_no", "p.k", "p.seal").distinct()


def ref_p11_format_line(spark, d):
    p = lines(spark, d)
    return p.select(t.seal_line(F.col("no"), F.col("page_no"), F.col("total_pages"), F.col("kid"), F.col("seal")).alias("printed"), t.payload(F.col("no"), F.col("page_no"), F.col("seal")).alias("code")).distinct()


def ref_p12_loose_line(spark, d):
    return lines(spark, d).select("line", t.parse_loose_line(F.col("line")).alias("p")).select("line", "p.iis_no", "p.k", "p.seal").distinct()


def ref_p13_typed_fields(spark, d):
    typed = table(spark, d, "pages").select(F.col("iis_no").alias("doc"), F.lower(F.replace("seal", F.lit("-"), F.lit(" "))).alias("code")).distinct()
    return typed.select("doc", "code", t.canonical_doc(F.col("doc")).alias("iis_no"), t.canonical_seal(F.col("code")).alias("seal"))


def ref_p14_fold_glyphs(spark, d):
    return table(spark, d, "registry").select("load_no", "row_no", t.fold_glyphs(F.col("emb_id")).alias("folded"))


def ref_p15_fold_punctuation(spark, d):
    return docs(spark, d).select("doc_id", t.fold_punctuation(F.col("body")).alias("folded"))


def ref_p16_words(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(t.words(F.col("body")), " ").alias("words"), F.size(t.words(F.col("body"))).cast("bigint").alias("n_words"))


def ref_p17_fold_letters(spark, d):
    return table(spark, d, "registry").select("load_no", "row_no", t.fold_letters(F.lower("company_name")).alias("folded"))


def ref_p18_match_key(spark, d):
    """Amounts, references and names under their keys, from the registry and the order totals."""
    money = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("money").alias("cls"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "PHP ").when(F.col("o_orderkey") % 3 == 1, "P").otherwise("₱"), F.format_number(F.floor("o_totalprice").cast("bigint"), 0), F.when(F.col("o_orderkey") % 2 == 0, ",5O").otherwise("")).alias("value"))
    name = table(spark, d, "registry").select((F.col("load_no") * 1000000 + F.col("row_no")).cast("bigint").alias("id"), F.lit("name").alias("cls"), F.col("company_name").alias("value")).filter("value IS NOT NULL")
    ref = table(spark, d, "registry").select((F.col("load_no") * 1000000 + F.col("row_no")).cast("bigint").alias("id"), F.lit("reference").alias("cls"), F.replace("iis_no", F.lit("-"), F.lit("~")).alias("value")).filter("value IS NOT NULL")
    return money.unionByName(name).unionByName(ref).select("id", "cls", t.match_key(F.col("cls"), F.col("value")).alias("match_key"))


def ref_p19_digits(spark, d):
    return table(spark, d, "registry").select("load_no", "row_no", t.digits(F.col("address")).alias("digits"))


def ref_p20_difference_reason(spark, d):
    r = table(spark, d, "registry").filter("emb_id IS NOT NULL AND attachment_ref IS NOT NULL")
    return r.select("load_no", "row_no", t.difference_reason(F.col("emb_id"), F.concat(F.lit("EMBR1-"), F.substring("emb_id", 7, 100))).alias("reason"), t.difference_reason(F.col("iis_no"), F.col("attachment_ref")).alias("reason_ref"))


def ref_p21_wrap_prefix(spark, d):
    r = table(spark, d, "registry").filter("subject_name IS NOT NULL AND company_name IS NOT NULL")
    cut = F.substring_index("company_name", " ", 2)
    return r.select("load_no", "row_no", t.is_wrap_prefix(F.col("company_name"), cut).alias("prefix"), t.is_wrap_prefix(F.col("company_name"), F.col("subject_name")).alias("other"))


def ref_p22_p24_evidence(spark, d):
    made = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Section "), F.element_at(F.array(*[F.lit(x) for x in ("IV", "Il", "XLC", "l2", "OO")]), (F.col("l_linenumber") % 5 + 1).cast("int"))).alias("citation"), F.concat(F.lit("P"), F.element_at(F.array(*[F.lit(x) for x in ("OO", "5O", "0l", "1,O", "l")]), (F.col("l_partkey") % 5 + 1).cast("int")), F.when(F.col("l_suppkey") % 2 == 0, "7").otherwise("")).alias("amount"))
    return made.select("l_orderkey", "l_linenumber", t.citation_has_evidence(F.col("citation")).alias("cited"), t.amount_has_evidence(F.col("amount")).alias("money"), t.glued_reads_as_amount(F.col("amount")).alias("glued")).distinct()


def ref_p25_safe_name(spark, d):
    return table(spark, d, "registry").select("load_no", "row_no", t.safe_name(F.col("attachment_ref")).alias("safe"))


def ref_p33_dispatch(spark, d):
    p = lines(spark, d)
    code = F.when(F.col("page_no") % 2 == 0, t.payload(F.col("no"), F.col("page_no"), F.col("seal"))).otherwise(F.col("line"))
    return p.select(code.alias("scan"), t.dispatch_scan(code).alias("p")).select("scan", "p.iis_no", "p.k", "p.seal").distinct()


def ref_k1_page_digest(spark, d):
    return docs(spark, d).select("doc_id", seals.page_digest(t.strip_seal_lines(F.col("body"))).alias("digest"))


def ref_k2_base32(spark, d):
    return docs(spark, d).select("doc_id", seals.base32_of_hex(seals.page_digest(F.col("body")), 8).alias("b32"))


def sealed(spark, d):
    return docs(spark, d).select("doc_id", F.format_string("R1-2026-%06d", (F.col("doc_id") / 4).cast("bigint")).alias("no"), (F.col("doc_id") % 4 + 1).alias("k"), F.lit(4).alias("n"), F.when(F.col("doc_id") % 5 == 4, "9").when(F.col("doc_id") % 5 == 3, "2").otherwise("1").alias("kid"), seals.page_digest(t.strip_seal_lines(F.col("body"))).alias("digest"))


def ref_k3_seal(spark, d):
    s = sealed(spark, d)
    return s.select("doc_id", "kid", seals.seal(KEYS, F.col("kid"), F.col("no"), F.col("k"), F.col("n"), F.col("digest")).alias("seal"))


def ref_k3_seal_arrow(spark, d):
    s = sealed(spark, d)
    return s.select("doc_id", "kid", seals.seal_arrow(KEYS)(F.col("kid"), seals.message(F.col("no"), F.col("k"), F.col("n"), F.col("digest"))).alias("seal"))


def ref_k4_seals_equal(spark, d):
    p = table(spark, d, "pages").select("iis_no", "page_no", "seal", "digest").distinct()
    return p.select("iis_no", "page_no", "digest", "seal", seals.seals_equal(F.col("seal"), F.when(F.col("page_no") % 2 == 0, F.col("seal"))).alias("same"))


def ref_k5_current_key(spark, d):
    p = table(spark, d, "pages").select(F.col("kid").cast("int").alias("kid")).agg(F.max("kid").alias("current"))
    return p.select(F.col("current").cast("bigint").alias("current_kid"), F.lit(int(seals.current_kid(KEYS))).cast("bigint").alias("newest_key"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("ref_") and callable(f)}

# --- SQL --------------------------------------------------------------------------------------------------------------

_NO = r"\b(?:EMB)?R1-(?:19|20)[0-9][0-9]-[0-9]{4,}\b"
_NORM = rf"""
  SELECT id, s, c, CASE WHEN regexp_matches(c, '(?i){_NO}') THEN 'iis_no' WHEN length(c) >= 12 AND regexp_matches(c, '(?i)[a-f0-9]{{8,}}') THEN 'token' ELSE 'unknown' END AS kind,
    CASE WHEN regexp_matches(c, '(?i){_NO}') THEN replace(upper(regexp_extract(c, '(?i){_NO}', 0)), 'EMB', '') WHEN length(c) >= 12 AND regexp_matches(c, '(?i)[a-f0-9]{{8,}}') THEN c ELSE regexp_replace(c, '^{W}+|{W}+$', '', 'g') END AS canonical_id
  FROM (SELECT id, s, CASE WHEN regexp_matches(s, '(?i)^https?://') AND NOT regexp_matches(s, '(?i){_NO}')
      THEN coalesce(list_filter(string_split(split_part(split_part(s, '?', 1), '#', 1), '/'), lambda x: x <> '')[-1], '') ELSE s END AS c
    FROM (SELECT id, regexp_replace(coalesce(payload, ''), '^{W}+|{W}+$', '', 'g') AS s FROM (<source>)))"""
_LOG = "SELECT DISTINCT id, queried_id AS payload FROM verify_log"


def _field(label: str) -> str:
    return f"nullif(regexp_replace(regexp_extract(page, '(?im)^{W}*{label}{W}*:{W}*(.+?){W}*$', 1), '^{W}+|{W}+$', '', 'g'), '')"


_PAGE = """SELECT load_no, row_no, 'Verification' || chr(10) || ' IIS No. : ' || coalesce(trim(iis_no), '') || chr(10) || 'Subject: ' || coalesce(trim(subject_name), '') || '.' || chr(10) || ' status :' || coalesce(trim(transaction_type), '') || '.  ' || chr(10)
  || 'Company  Name : ' || coalesce(trim(company_name), '') || '!' AS page FROM registry"""
_B32 = "list_aggregate(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> CAST(35 - 5 * i AS BIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')"


def _hex40(x: str) -> str:
    return f"CAST('0x' || substr({x}, 1, 10) AS BIGINT)"


def sql_hmac(secret: str, msg: str) -> str:
    inner, outer = seals.pads(secret)
    return f"sha256(unhex('{outer.hex()}' || sha256(unhex('{inner.hex()}' || hex(encode({msg}))))))"


def sql_seal(digest_hex: str) -> str:
    b = _B32.replace("v >>", f"{_hex40(digest_hex)} >>")
    return f"(substr({b}, 1, 4) || '-' || substr({b}, 5, 4))"


_SEALED = f"""SELECT doc_id, kid, CASE kid WHEN '1' THEN <h1> WHEN '2' THEN <h2> END AS h FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '9' WHEN doc_id % 5 = 3 THEN '2' ELSE '1' END AS kid,
    concat_ws('|', printf('R1-2026-%06d', doc_id // 4), doc_id % 4 + 1, 4, sha256({strip('body')})) AS msg FROM ({SQL_DOCS}))"""
_SEALED = _SEALED.replace("<h1>", sql_hmac(KEYS["1"], "msg")).replace("<h2>", sql_hmac(KEYS["2"], "msg"))
_KEY = f"lower({fold(canon('value'))})"
_WORDS = f"lower(translate({strip('body')}, '{t.PUNCT[0]}', '{t.PUNCT[1].replace(chr(39), chr(39) * 2)}'))"
_NAMED = f"replace(replace(replace({_KEY}, 'rn', 'm'), 'cl', 'd'), 'vv', 'w')"
_PESO = f"regexp_replace({_KEY}, '^(?:php|p)\\s?', '₱')"
_CODE = "SELECT DISTINCT CASE page_no % 3 WHEN 0 THEN lower(c) WHEN 1 THEN c ELSE ' ' || c END AS code FROM (SELECT page_no, concat_ws('|', 'CVR', no, page_no, seal) AS c FROM (<lines>)) "
_LOOSE = rf"""SELECT <x> AS x, CASE WHEN ok THEN no END AS iis_no, CASE WHEN ok THEN k END AS k, CASE WHEN ok THEN seal END AS seal FROM (SELECT *, regexp_matches(<x>, '(?i)·|EMB\b|p{W}*[0-9]+{W}*/') AND no <> '' AND seal IS NOT NULL AS ok FROM (
  SELECT DISTINCT <x>, regexp_extract(upper(<x>), 'R1-(?:19|20)[0-9][0-9]-[0-9]{{3,}}', 0) AS no, regexp_extract_all(upper(<x>), '[A-Z2-7]{{4}}-[A-Z2-7]{{4}}')[-1] AS seal, regexp_extract(upper(<x>), 'P{W}*([0-9]+){W}*/', 1) AS k FROM <src>))"""

SQL = {
    "ref_p1_normalize": f"SELECT id, kind, canonical_id FROM ({_NORM.replace("<source>", SQL_PAYLOADS)})",
    "ref_p3_live_record": f"""SELECT DISTINCT id, CASE WHEN id % 7 = 0 THEN NULL WHEN kind = 'iis_no' THEN canonical_id ELSE coalesce(nullif(regexp_extract(s, 'R1-(?:19|20)[0-9][0-9]-[0-9]{{4,}}', 0), ''), canonical_id) END AS iis_no
      FROM ({_NORM.replace("<source>", _LOG)})""",
    "ref_p4_lookup_url": f"SELECT id, '{BASE}' || CASE WHEN kind = 'token' THEN '/view/' || canonical_id ELSE '/search?q=' || replace(url_encode(canonical_id), '%2A', '*') END AS url FROM ({_NORM.replace("<source>", SQL_PAYLOADS)})",
    "ref_p5_verification_page": f"""SELECT * FROM (SELECT load_no, row_no, {_field(f'IIS{W}*No[.]?')} AS iis_no, {_field('Subject')} AS subject, {_field('Status')} AS status, {_field('Division')} AS division, {_field(f'Company{W}*Name')} AS company_name
      FROM ({_PAGE})) WHERE regexp_matches(iis_no, '^R1-(?:20|21)[0-9][0-9]-[0-9]{{6}}$')""",
    "ref_p6_may_fetch": "SELECT DISTINCT id, id % 6 IN (0, 1) AS ok FROM verify_log",
    "ref_p7_canonicalize": f"SELECT doc_id, {canon('body')} AS canonical FROM ({SQL_DOCS})",
    "ref_p8_strip_seal_lines": f"SELECT doc_id, {strip('body')} AS stripped FROM ({SQL_DOCS})",
    "ref_p9_parse_seal_line": f"""SELECT DISTINCT line, regexp_extract(line, '{LINE}', 1) AS iis_no, CAST(regexp_extract(line, '{LINE}', 2) AS INTEGER) AS k, CAST(regexp_extract(line, '{LINE}', 3) AS INTEGER) AS n,
      regexp_extract(line, '{LINE}', 4) AS kid, regexp_extract(line, '{LINE}', 5) AS seal FROM ({SQL_LINES}) WHERE regexp_matches(line, '{LINE}')""",
    "ref_p10_parse_payload": rf"""SELECT code, nullif(upper(regexp_extract(code, '(?i)^CVR\|([^|]+)\|([0-9]+)\|([0-9A-Za-z-]+)', 1)), '') AS iis_no, TRY_CAST(regexp_extract(code, '(?i)^CVR\|([^|]+)\|([0-9]+)\|([0-9A-Za-z-]+)', 2) AS INTEGER) AS k,
      nullif(upper(regexp_extract(code, '(?i)^CVR\|([^|]+)\|([0-9]+)\|([0-9A-Za-z-]+)', 3)), '') AS seal FROM ({_CODE.replace("<lines>", SQL_LINES)}) WHERE regexp_matches(code, '(?i)^CVR\|([^|]+)\|([0-9]+)\|([0-9A-Za-z-]+)')""",
    "ref_p11_format_line": f"SELECT DISTINCT l AS printed, concat_ws('|', 'CVR', no, page_no, seal) AS code FROM ({SQL_LINES})",
    "ref_p12_loose_line": "SELECT x AS line, iis_no, k, seal FROM (" + _LOOSE.replace("<x>", "line").replace("<src>", f"({SQL_LINES})") + ")",
    "ref_p13_typed_fields": f"""SELECT doc, code, regexp_replace(upper(regexp_replace(doc, '^{W}+|{W}+$', '', 'g')), '^EMBR1-', 'R1-') AS iis_no,
      CASE WHEN length(regexp_replace(upper(code), '[^0-9A-Z]', '', 'g')) = 8 THEN substr(regexp_replace(upper(code), '[^0-9A-Z]', '', 'g'), 1, 4) || '-' || substr(regexp_replace(upper(code), '[^0-9A-Z]', '', 'g'), 5, 4) ELSE regexp_replace(upper(code), '[^0-9A-Z]', '', 'g') END AS seal
      FROM (SELECT DISTINCT iis_no AS doc, lower(replace(seal, '-', ' ')) AS code FROM pages)""",
    "ref_p14_fold_glyphs": f"SELECT load_no, row_no, {fold('emb_id')} AS folded FROM registry",
    "ref_p15_fold_punctuation": f"SELECT doc_id, translate(coalesce(body, ''), '{t.PUNCT[0]}', '{t.PUNCT[1].replace(chr(39), chr(39) * 2)}') AS folded FROM ({SQL_DOCS})",
    "ref_p16_words": f"SELECT doc_id, array_to_string(list_filter(string_split({_WORDS}, ' '), lambda w: w <> ''), ' ') AS words, CAST(len(list_filter(string_split({_WORDS}, ' '), lambda w: w <> '')) AS BIGINT) AS n_words FROM ({SQL_DOCS})",
    "ref_p17_fold_letters": "SELECT load_no, row_no, replace(replace(replace(lower(company_name), 'rn', 'm'), 'cl', 'd'), 'vv', 'w') AS folded FROM registry",
    "ref_p18_match_key": rf"""
      WITH v AS (SELECT o_orderkey AS id, 'money' AS cls, CASE o_orderkey % 3 WHEN 0 THEN 'PHP ' WHEN 1 THEN 'P' ELSE '₱' END || format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) || CASE WHEN o_orderkey % 2 = 0 THEN ',5O' ELSE '' END AS value FROM orders
        UNION ALL SELECT CAST(load_no AS BIGINT) * 1000000 + row_no, 'name', company_name FROM registry WHERE company_name IS NOT NULL
        UNION ALL SELECT CAST(load_no AS BIGINT) * 1000000 + row_no, 'reference', replace(iis_no, '-', '~') FROM registry WHERE iis_no IS NOT NULL)
      SELECT id, cls, CASE cls WHEN 'name' THEN {_NAMED} WHEN 'reference' THEN replace({_PESO}, '~', '-') ELSE
        regexp_replace(CASE WHEN regexp_matches({_PESO}, ',[0-9]{{2}}$') THEN regexp_replace(regexp_replace({_PESO}, ',([0-9]{{2}})$', '.\1'), ',', '', 'g') ELSE replace({_PESO}, ',', '') END, '', '') END AS match_key FROM v""",
    "ref_p19_digits": "SELECT load_no, row_no, regexp_replace(coalesce(address, ''), '[^0-9]', '', 'g') AS digits FROM registry",
    "ref_p20_difference_reason": f"""SELECT load_no, row_no, CASE WHEN length(a) <> length(b) THEN 'digit-count' WHEN a <> b THEN 'digit-substitution' ELSE 'text' END AS reason, CASE WHEN length(c) <> length(e) THEN 'digit-count' WHEN c <> e THEN 'digit-substitution' ELSE 'text' END AS reason_ref
      FROM (SELECT load_no, row_no, regexp_replace({fold('emb_id')}, '[^0-9]', '', 'g') AS a, regexp_replace({fold("('EMBR1-' || substr(emb_id, 7, 100))")}, '[^0-9]', '', 'g') AS b, regexp_replace({fold('iis_no')}, '[^0-9]', '', 'g') AS c, regexp_replace({fold('attachment_ref')}, '[^0-9]', '', 'g') AS e
      FROM registry WHERE emb_id IS NOT NULL AND attachment_ref IS NOT NULL)""",
    "ref_p21_wrap_prefix": """SELECT load_no, row_no, true AS prefix, list_slice(x, 1, least(len(x), len(y))) = list_slice(y, 1, least(len(x), len(y))) AS other
      FROM (SELECT load_no, row_no, string_split(company_name, ' ') AS x, string_split(subject_name, ' ') AS y FROM registry WHERE subject_name IS NOT NULL AND company_name IS NOT NULL)""",
    "ref_p22_p24_evidence": """SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 5 <> 4 AS cited, regexp_matches(a, '[0-9,.]') AS money, regexp_matches(a, '[,.]') OR regexp_matches(substr(a, 2), '^[1-9][0-9]+$') AS glued
      FROM (SELECT l_orderkey, l_linenumber, 'P' || ['OO', '5O', '0l', '1,O', 'l'][l_partkey % 5 + 1] || CASE WHEN l_suppkey % 2 = 0 THEN '7' ELSE '' END AS a FROM lineitem)""",
    "ref_p25_safe_name": "SELECT load_no, row_no, regexp_replace(coalesce(attachment_ref, ''), '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM registry",
    "ref_p33_dispatch": f"""
      WITH s AS (SELECT DISTINCT CASE WHEN page_no % 2 = 0 THEN concat_ws('|', 'CVR', no, page_no, seal) ELSE line END AS scan, page_no % 2 = 0 AS coded, no AS c_no, CAST(page_no AS VARCHAR) AS c_k, seal AS c_seal FROM ({SQL_LINES})),
      l AS ({_LOOSE.replace("<x>", "scan").replace("<src>", "s")})
      SELECT DISTINCT s.scan, CASE WHEN coded THEN c_no WHEN l.k <> '' THEN l.iis_no END AS iis_no, CASE WHEN coded THEN c_k WHEN l.k <> '' THEN l.k END AS k, CASE WHEN coded THEN c_seal WHEN l.k <> '' THEN l.seal END AS seal FROM s LEFT JOIN l ON s.scan = l.x""",
    "ref_k1_page_digest": f"SELECT doc_id, sha256({strip('body')}) AS digest FROM ({SQL_DOCS})",
    "ref_k2_base32": f"SELECT doc_id, {_B32} AS b32 FROM (SELECT doc_id, {_hex40('h')} AS v FROM (SELECT doc_id, sha256({canon('body')}) AS h FROM ({SQL_DOCS})))",
    "ref_k3_seal": f"SELECT doc_id, kid, {sql_seal('h')} AS seal FROM ({_SEALED})",
    "ref_k3_seal_arrow": f"SELECT doc_id, kid, {sql_seal('h')} AS seal FROM ({_SEALED})",
    "ref_k4_seals_equal": "SELECT DISTINCT iis_no, page_no, digest, seal, page_no % 2 = 0 OR coalesce(seal, '') = '' AS same FROM pages",
    "ref_k5_current_key": "SELECT max(CAST(kid AS BIGINT)) AS current_kid, CAST(2 AS BIGINT) AS newest_key FROM pages",
}
