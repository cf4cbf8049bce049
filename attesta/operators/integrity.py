"""Decisions on single pages and on whole documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from attesta.functions.seals import page_digest, seal, seals_equal
from attesta.functions.text import parse_seal_line, strip_seal_lines, text
from attesta.operators.registry import first_reached_mode
from attesta.sources.durable import durable

# What a status says to the reader (fixed values).
PAGE_STATES = {"page_verified": "Page ok", "invalid_seal": "Bad seal", "not_sealed": "Not sealed", "page_count_mismatch": "Count off", "invalid_code": "Unreadable"}
PAGE_LABELS = {"verified": "verified", "content_altered": "altered", "not_sealed": "unsealed"}


def page_verdicts(requests: DataFrame, pages: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """The verdict on seal lines, in strict order.

    requests: (req_id, iis_no, k, n, seal); pages unique by (iis_no, page_no). n may be null (not claimed). A page whose
    key is unknown is 'unknown_key': where a service would fail, a batch says so and goes on.
    """
    on_file = pages.select("iis_no", F.col("page_no").alias("k"), "total_pages", "kid", F.col("seal").alias("stored"), "digest", F.lit(True).alias("on_file"))
    bad = (text(F.col("seal")) == "") | (text(F.col("iis_no")) == "") | F.col("k").isNull()
    j = requests.join(on_file, ["iis_no", "k"], "left")
    expected = seal(keys, F.col("kid"), F.col("iis_no"), F.col("k"), F.col("total_pages"), F.col("digest"))
    genuine = seals_equal(expected, F.col("seal")) & seals_equal(F.col("stored"), F.col("seal"))
    status = (
        F.when(bad, "invalid_code").when(F.col("on_file").isNull(), "not_sealed").when(F.col("n").isNotNull() & (F.col("n") != F.col("total_pages")), "page_count_mismatch")
        .when(~F.col("kid").isin(*keys), "unknown_key").when(genuine, "page_verified").otherwise("invalid_seal")
    )
    return j.select("req_id", "iis_no", "k", "n", F.when(F.col("on_file") & ~bad, F.col("total_pages")).alias("expected_pages"), status.alias("status"))


def page_status(page_texts: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """(doc_id, position, iis_no, claimed_k, claimed_n, kid, seal, status) of each page of documents (doc_id, position, text).

    'not_sealed' without a seal line, 'verified' where the line's seal belongs to the text, else 'content_altered' (also for
    an unknown key). A null text is an empty page.
    """
    p = page_texts.select("doc_id", "position", parse_seal_line(F.col("text")).alias("p"), page_digest(strip_seal_lines(F.col("text"))).alias("digest"))
    ok = F.coalesce(seals_equal(seal(keys, F.col("p.kid"), F.col("p.iis_no"), F.col("p.k"), F.col("p.n"), F.col("digest")), F.col("p.seal")) & F.col("p.kid").isin(*keys), F.lit(False))
    status = F.when(F.col("p").isNull(), "not_sealed").when(ok, "verified").otherwise("content_altered")
    return p.select("doc_id", "position", "p.iis_no", F.col("p.k").alias("claimed_k"), F.col("p.n").alias("claimed_n"), "p.kid", "p.seal", status.alias("status"))


def document_findings(pages: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """W1 and W1a over the rows of page_status: (findings, documents).

    findings: (doc_id, phase, position, rule, finding) in the order phase, position, rule. documents: (doc_id, iis_no,
    claimed_pages, actual_pages, n_findings, status). The document's number is the one that first reaches the greatest count
    among its sealed pages, its length the one among the pages of that number. expected: (doc_id, expected_no), unique by doc_id: the number that the
    caller expects of a document takes the place of its own; null and '' expect none.
    """
    pages = durable(pages)  # seals are computed once; read for the numbers, the lengths, the rules and the missing pages
    sealed = pages.filter("status <> 'not_sealed'")
    number = first_reached_mode(sealed, ["doc_id"], "iis_no", ["position"]).withColumnRenamed("iis_no", "doc_no")
    if expected is not None:
        wanted = expected.select("doc_id", F.nullif("expected_no", F.lit("")).alias("_e"))
        number = pages.select("doc_id").distinct().join(number, "doc_id", "left").join(wanted, "doc_id", "left").select("doc_id", F.coalesce("_e", "doc_no").alias("doc_no"))
    length = first_reached_mode(sealed.join(number, "doc_id").filter("iis_no = doc_no"), ["doc_id"], "claimed_n", ["position"]).withColumnRenamed("claimed_n", "doc_n").withColumn("doc_n", F.nullif("doc_n", F.lit(0)))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("actual_pages"), F.count_if(F.col("status") != "not_sealed").alias("n_sealed"))
    head = size.join(number, "doc_id", "left").join(length, "doc_id", "left")
    p = pages.join(head.select("doc_id", "doc_no"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id", "claimed_k").orderBy("position"))
    p = p.withColumn("nth", F.when(F.col("status") != "not_sealed", nth))
    pos, k = F.col("position").cast("string"), F.col("claimed_k").cast("string")
    say = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    s = F.col("status") != "not_sealed"
    rules = F.array(
        F.struct(F.lit(0).alias("rule"), F.when(~s, say("Page at position ", pos, " carries no seal (inserted or unsealed).")).alias("finding")),
        F.struct(F.lit(1).alias("rule"), F.when(s & (F.col("iis_no") != F.col("doc_no")), say("Page ", pos, " belongs to a different document (", F.col("iis_no"), ").")).alias("finding")),
        F.struct(F.lit(2).alias("rule"), F.when(F.col("status") == "content_altered", say("Page ", pos, " (page ", k, ") content was altered.")).alias("finding")),
        F.struct(F.lit(3).alias("rule"), F.when(s & (F.col("claimed_k") != F.col("position")), say("Page ", pos, " is out of order (claims to be page ", k, ").")).alias("finding")),
        F.struct(F.lit(4).alias("rule"), F.when(F.col("nth") > 1, say("Page ", k, " is duplicated.")).alias("finding")),
    )
    by_page = p.select("doc_id", F.lit(1).alias("phase"), "position", F.explode(rules).alias("r")).select("doc_id", "phase", "position", "r.rule", "r.finding").filter("finding IS NOT NULL")
    seen = sealed.groupBy("doc_id").agg(F.collect_set("claimed_k").alias("seen"))  # at most one entry a page number
    n = F.col("doc_n").cast("string")
    absent = head.filter("doc_n >= 1").join(seen, "doc_id").select("doc_id", "doc_n", F.explode(F.array_except(F.sequence(F.lit(1), F.col("doc_n")), F.col("seen"))).alias("position"))
    absent = absent.select("doc_id", F.lit(2).alias("phase"), "position", F.lit(5).alias("rule"), say("Page ", F.col("position").cast("string"), " of ", n, " is missing.").alias("finding"))
    count = head.filter("doc_n IS NOT NULL AND doc_n <> actual_pages").select("doc_id", F.lit(3).alias("phase"), F.lit(0).alias("position"), F.lit(6).alias("rule"), say("Document should have ", n, " pages but has ", F.col("actual_pages").cast("string"), ".").alias("finding"))
    findings = by_page.unionByName(absent).unionByName(count)
    found = findings.groupBy("doc_id").agg(F.count("*").alias("n_findings"))
    status = F.when((F.coalesce("n_findings", F.lit(0)) == 0) & (F.col("n_sealed") == F.col("actual_pages")), "intact").otherwise("tampered")
    docs = head.join(found, "doc_id", "left").select("doc_id", F.col("doc_no").alias("iis_no"), F.col("doc_n").alias("claimed_pages"), "actual_pages", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), status.alias("status"))
    return findings, docs


def seal_fit_report(fits: DataFrame, spots: DataFrame, numbers: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The pre-flight of sealing, one row a document: what the seal would cover, where it could go instead, and the document's number.

    fits: (doc_id, clear, ruled) of spatial.document_fit; spots: those of spatial.clear_spots; numbers: those of
    registry.control_numbers; resolutions: those of registry.qr_resolutions. The number in the text comes before the one that
    the code leads to, which isn't asked then. (doc_id, clear, ruled, move_x, move_y, iis_no, source, candidates, lookup_ok,
    lookup_reason): move_x and move_y are null where the usual place is clear or none is free, source is 'text', 'iis' or null,
    candidates are the numbers in the text, the best first, lookup_ok and lookup_reason are null where the text says it.
    """
    said = numbers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "iis_no"))).alias("_n")).select("doc_id", F.transform("_n", lambda x: x["iis_no"]).alias("candidates"))
    j = fits.join(spots.select("doc_id", "x0", "y0"), "doc_id", "left").join(said, "doc_id", "left").join(resolutions.select("doc_id", "ok", "reason", F.col("iis_no").alias("_q")), "doc_id", "left")
    none = F.array().cast("array<string>")
    best, ok = F.get("candidates", F.lit(0)), F.coalesce("ok", F.lit(False))
    return j.select(
        "doc_id", "clear", "ruled", F.when(~F.col("clear"), F.col("x0")).alias("move_x"), F.when(~F.col("clear"), F.col("y0")).alias("move_y"),
        F.coalesce(best, F.when(ok, F.col("_q"))).alias("iis_no"), F.when(best.isNotNull(), "text").when(ok, "iis").alias("source"), F.coalesce("candidates", none).alias("candidates"),
        F.when(best.isNull(), ok).alias("lookup_ok"), F.when(best.isNull() & ~ok, F.coalesce("reason", F.lit("unreachable"))).alias("lookup_reason"),
    )


def document_report(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One line a page and the stamp of its document: 'a of b pages'."""
    label = F.create_map(*[F.lit(x) for p in PAGE_LABELS.items() for x in p])
    d = documents.select("doc_id", F.initcap("status").alias("stamp"), F.concat_ws(" of ", F.col("actual_pages").cast("string"), F.concat(F.coalesce(F.col("claimed_pages").cast("string"), F.lit("?")), F.lit(" pages"))).alias("extent"))
    return pages.join(d, "doc_id").select("doc_id", "position", label[F.col("status")].alias("label"), "stamp", "extent")


def seal_request_errors(requests: DataFrame) -> DataFrame:
    """F8 for sealing: requests (req_id, has_file, iis_no, at) with `error` (null for a good one) and the position x0, y0.

    `at` is JSON {x0, y0}; text that is no JSON is an error, a position without two finite numbers counts as none.
    """
    at = F.from_json(F.col("at"), "x0 double, y0 double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    r = requests.withColumn("_p", at)
    ok = F.coalesce(finite(F.col("_p.x0")) & finite(F.col("_p.y0")), F.lit(False))
    error = (
        F.when(~F.coalesce("has_file", F.lit(False)), "No file uploaded.").when(F.trim(text(F.col("iis_no"))) == "", "iisNo is required.")
        .when((text(F.col("at")) != "") & F.col("_p._bad").isNotNull() & ~text(F.col("at")).rlike(r"^\s*\{.*\}\s*$"), "Bad seal position.")
    )
    return r.select("req_id", error.alias("error"), F.when(error.isNull() & ok, F.col("_p.x0")).alias("x0"), F.when(error.isNull() & ok, F.col("_p.y0")).alias("y0"))


def image_request_errors(requests: DataFrame) -> DataFrame:
    """F8 for photographs: requests (req_id, has_file, doc, k TEXT) with `error`, null for a good one."""
    k = text(F.col("k")).try_cast("double")
    bad = (F.trim(text(F.col("doc"))) == "") | k.isNull() | F.isnan(k) | (k < 1) | (F.abs(k) == float("inf"))
    return requests.select("req_id", F.when(~F.coalesce("has_file", F.lit(False)), "No image uploaded.").when(bad, "Need the control number and page number.").alias("error"))


def sealed_pages(page_texts: DataFrame, keys: Mapping[str, str], kid: str) -> DataFrame:
    """Sealing: pages (iis_no, page_no, total_pages, digest, seal, kid, footer, payload) of documents (iis_no, page_no, text).

    The digest is that of the text without seal lines, so sealing again changes nothing; total_pages is the document's count.
    """
    from attesta.functions.text import payload, seal_line

    n = page_texts.groupBy("iis_no").agg(F.count("*").cast("int").alias("total_pages"))
    p = page_texts.join(n, "iis_no").withColumn("digest", page_digest(strip_seal_lines(F.col("text")))).withColumn("kid", F.lit(kid))
    p = p.withColumn("seal", seal(keys, F.col("kid"), F.col("iis_no"), F.col("page_no"), F.col("total_pages"), F.col("digest")))
    return p.select("iis_no", "page_no", "total_pages", "digest", "seal", "kid", seal_line(F.col("iis_no"), F.col("page_no"), F.col("total_pages"), F.col("kid"), F.col("seal")).alias("footer"), payload(F.col("iis_no"), F.col("page_no"), F.col("seal")).alias("payload"))
