"""The registry: cells of a spreadsheet, keyed upserts, look-ups with fallback, and decisions with their log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attesta.functions.text import js_trim, may_fetch, normalize_id, parse_verification_page, text

ATTRIBUTES = ("subject_name", "company_name", "address", "emb_id", "transaction_type", "attachment_ref")

# Q1: the schemas of the persisted tables.
DOCUMENTS = T.StructType([T.StructField("iis_no", T.StringType(), False), *[T.StructField(c, T.StringType()) for c in ATTRIBUTES], T.StructField("source", T.StringType(), False), T.StructField("first_seen", T.TimestampType()), T.StructField("last_verified", T.TimestampType())])
VERIFY_LOG = T.StructType([T.StructField("ts", T.TimestampType(), False), T.StructField("queried_id", T.StringType()), T.StructField("resolved_iis_no", T.StringType()), T.StructField("outcome", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("client_hint", T.StringType())])
PAGES = T.StructType([T.StructField("iis_no", T.StringType(), False), T.StructField("page_no", T.IntegerType(), False), T.StructField("total_pages", T.IntegerType(), False), *[T.StructField(c, T.StringType(), c != "sealed_pdf_path") for c in ("digest", "seal", "kid", "sealed_pdf_path")], T.StructField("created_at", T.TimestampType(), False)])


def cell_text(value: Column, link: Column) -> Column:
    """What a cell says: its text, else its link, else ''."""
    return F.coalesce(value, link, F.lit(""))


def cell_link(value: Column, link: Column) -> Column:
    """Where a cell points: its link first."""
    return F.coalesce(link, value, F.lit(""))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order. One aggregation with partial maxima, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return rows.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top._row.*")


def merge_batch(documents: DataFrame, batch: DataFrame, order: Sequence[Column], live: bool = False) -> DataFrame:
    """Q2 and Q5: upsert of `batch` (iis_no, attributes, at) into `documents`.

    Rows without a number are skipped; of several rows of a number the last one wins. The load keeps source, first_seen and
    last_verified of a known record; a live record sets source and last_verified and keeps first_seen.
    """
    rows = batch.withColumn("iis_no", js_trim(F.col("iis_no"))).filter("iis_no <> ''")
    # One aggregation gives the last row of a number and the first time that it came.
    last = F.max(F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)], F.struct(F.col("at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in ATTRIBUTES]).alias("_row")))
    new = rows.groupBy("iis_no").agg(last.alias("_top"), F.min("at").alias("_first")).select("iis_no", F.lit(True).alias("_new"), "_first", "_top._row.*")
    both = documents.join(new, "iis_no", "full_outer")
    fresh, known = F.coalesce("_new", F.lit(False)), F.col("source").isNotNull()
    source = F.when(fresh & F.lit(live), "iis_live").otherwise(F.coalesce("source", F.lit("excel")))
    verified = F.when(fresh & F.lit(live), F.col("_at")).otherwise(F.col("last_verified"))
    return both.select("iis_no", *[F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ATTRIBUTES], source.alias("source"), F.when(known, F.col("first_seen")).otherwise(F.col("_first")).alias("first_seen"), verified.alias("last_verified"))


def ingest_metrics(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """A1 and Q3: (inserted, updated, total) of a load. A number counts as inserted the first time that it is seen."""
    keys = batch.select(js_trim(F.col("iis_no")).alias("iis_no")).filter("iis_no <> ''").groupBy("iis_no").agg(F.count("*").alias("n"))
    fresh = keys.join(documents.select("iis_no"), "iis_no", "left_anti").agg(F.count("*").alias("inserted"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).join(F.broadcast(fresh)).select("inserted", (F.col("total") - F.col("inserted")).alias("updated"), "total")


def upsert_pages(pages: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Q9: the last delivery of each page of a document overwrites the earlier ones."""
    return keep_last(pages, ["iis_no", "page_no"], order)


def lookup(requests: DataFrame, documents: DataFrame, key: str = "lookup_key") -> DataFrame:
    """Requests with the record that has their key, `hit` null where none has. Blank keys never match."""
    record = documents.select(F.col("iis_no").alias(key), F.struct(*documents.columns).alias("hit"))
    return requests.join(record, key, "left")


def verify(requests: DataFrame, documents: DataFrame, live: DataFrame) -> DataFrame:
    """The status of each request and the row that goes into the log.

    requests: (req_id, ts, payload, path, client_hint); documents and live: registry records with unique iis_no. Only
    misses on the staff path reach the live source. Null payloads are invalid.
    """
    n = requests.withColumn("n", normalize_id(F.col("payload"))).select("*", "n.kind", "n.canonical_id", F.when(F.col("n.kind") != "unknown", F.col("n.lookup_key")).alias("lookup_key"))
    found = lookup(n, documents.select("iis_no", F.lit(True).alias("_h")))
    staff = (F.col("path") == "staff") & F.col("hit").isNull() & (F.col("kind") != "unknown")
    found = found.withColumn("_live", F.when(staff, F.col("lookup_key"))).join(live.select(F.col("iis_no").alias("_live"), F.lit(True).alias("live")), "_live", "left")
    hit, lively = F.col("hit").isNotNull(), F.col("live").isNotNull()
    status = F.when(F.col("kind") == "unknown", "invalid").when(hit, "verified_local").when(lively, "verified_live").when(F.col("path") == "staff", "not_found").otherwise("needs_staff")
    outcome = F.when(hit, "local_hit").when(lively, "iis_hit").otherwise("not_found")
    return found.select("req_id", "ts", F.col("n.raw").alias("queried_id"), F.when(hit | lively, F.col("lookup_key")).alias("resolved_iis_no"), status.alias("status"), outcome.alias("outcome"), "path", "client_hint")


def backfill(requests: DataFrame, documents: DataFrame, live: DataFrame) -> DataFrame:
    """As `verify`, but what one request found live is in the registry for the later ones, in the order of (ts, req_id).

    The first staff request of a live record that isn't on file finds it live; every later request of it, on any path, finds
    it locally. Those first requests are one row a key, found before the look-ups, so each look-up is done once.
    """
    n = requests.withColumn("n", normalize_id(F.col("payload"))).select("*", "n.kind", F.when(F.col("n.kind") != "unknown", F.col("n.lookup_key")).alias("lookup_key"))
    first = n.filter((F.col("path") == "staff") & F.col("lookup_key").isNotNull()).groupBy("lookup_key").agg(F.min(F.struct("ts", "req_id")).alias("since"))
    first = first.join(live.select(F.col("iis_no").alias("lookup_key")), "lookup_key", "left_semi")
    found = lookup(n, documents.select("iis_no", F.lit(True).alias("_h"))).join(first, "lookup_key", "left")
    order = F.struct("ts", "req_id")
    hit, found_live, later = F.col("hit").isNotNull(), F.col("since") == order, F.col("since") < order
    status = (
        F.when(F.col("kind") == "unknown", "invalid").when(hit, "verified_local").when(found_live, "verified_live").when(later, "verified_local")
        .when(F.col("path") == "staff", "not_found").otherwise("needs_staff")
    )
    outcome = F.when(hit, "local_hit").when(found_live, "iis_hit").when(later, "local_hit").otherwise("not_found")
    known = hit | F.coalesce(found_live, F.lit(False)) | F.coalesce(later, F.lit(False))
    return found.select("req_id", "ts", F.col("n.raw").alias("queried_id"), F.when(known, F.col("lookup_key")).alias("resolved_iis_no"), status.alias("status"), outcome.alias("outcome"), "path", "client_hint")


def qr_resolutions(documents: DataFrame, codes: DataFrame, live_pages: DataFrame, base: str) -> DataFrame:
    """(doc_id, ok, reason, iis_no, url, page_no, record): the record that a document's own code leads to.

    documents: (doc_id); codes: (doc_id, page_no, seq, url), what a scanner read on the first pages; live_pages: (url,
    page_text), what the followed URLs answered, null where nothing did. The first code by page and place counts. reason, null
    where ok: 'no-qr' (no code, or one that mustn't be followed from `base`'s host), 'unreachable' (no answer), 'no-record'
    (an answer without a number that can be sealed). URLs that mustn't be followed never meet live_pages.
    """
    first = codes.filter("url IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("url", "page_no"), F.struct("page_no", "seq")).alias("c")).select("doc_id", "c.*")
    gate = may_fetch(F.col("url"), F.lit(base))
    followed = documents.select("doc_id").distinct().join(first, "doc_id", "left").withColumn("_u", F.when(gate, F.col("url")))
    pages = live_pages.groupBy(F.col("url").alias("_u")).agg(F.max("page_text").alias("page_text"))
    got = followed.join(pages, "_u", "left").withColumn("record", parse_verification_page(F.col("page_text")))
    reason = F.when(F.col("_u").isNull(), "no-qr").when(F.col("page_text").isNull(), "unreachable").when(F.col("record").isNull(), "no-record")
    return got.select("doc_id", reason.isNull().alias("ok"), reason.alias("reason"), "record.iis_no", F.when(reason.isNull(), F.col("url")).alias("url"), F.when(reason.isNull(), F.col("page_no")).alias("page_no"), "record")


def first_reached_mode(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """A2: for each group the value that is the first to reach the greatest count, in the given order.

    It is the value whose last occurrence comes first among the values of the greatest count: counts and last places are
    aggregated in two steps, without a window over the group. Null values count as a value; an empty group gives no row.
    """
    per = rows.groupBy(*group, value).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_last"))
    top = per.groupBy(*group).agg(F.max("_n").alias("_n")) if group else per.agg(F.max("_n").alias("_n"))
    best = per.join(top, [*group, "_n"]) if group else per.join(F.broadcast(top), "_n")
    agg = best.groupBy(*group).agg(F.min_by(value, "_last").alias(value))
    return agg


def page_list(pages: DataFrame) -> DataFrame:
    """Q8 and O1: the pages on record of each document with the printed line and whether an image is on file, and their total from the first page."""
    from attesta.functions.text import seal_line

    total = pages.groupBy("iis_no").agg(F.min_by("total_pages", "page_no").alias("total"))
    line = seal_line(F.col("iis_no"), F.col("page_no"), F.col("total_pages"), F.col("kid"), F.col("seal"))
    return pages.join(total, "iis_no").select("iis_no", "total", F.col("page_no").alias("k"), F.col("total_pages").alias("n"), "seal", "kid", line.alias("footer"), (text(F.col("sealed_pdf_path")) != "").alias("has_image"))


def control_numbers(page_texts: DataFrame) -> DataFrame:
    """The control numbers in the pages of a document: (doc_id, iis_no, pages, labelled, rank), rank 1 the best.

    page_texts: (doc_id, page_no, text). Labelled comes before bare, then more pages, then the first seen. A number inside a
    longer token is none; a label within the 24 characters before it counts.
    """
    number = r"(?<![A-Za-z0-9])R1-(?:20|21)[0-9][0-9]-[0-9]{6}(?![A-Za-z0-9])"
    label = r"(?i)control\s*(?:no\.?|number)\s*:?\s*\z"
    # The pieces between the numbers tell where each stands: piece i ends where number i begins.
    t = text(F.col("text"))
    found = page_texts.select("doc_id", "page_no", F.regexp_extract_all(t, F.lit(f"({number})"), 1).alias("ids"), F.split(t, number).alias("between")).filter(F.size("ids") > 0)
    each = found.select("doc_id", "page_no", "between", F.posexplode("ids").alias("pos", "iis_no"))
    labelled = F.substring(F.get("between", F.col("pos")), -24, 24).rlike(label)
    groups = each.groupBy("doc_id", "iis_no").agg(F.bool_or(labelled).alias("labelled"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.min(F.struct("page_no", "pos")).alias("seen"))
    w = Window.partitionBy("doc_id").orderBy(F.col("labelled").desc(), F.size("pages").desc(), F.col("seen"))
    return groups.withColumn("rank", F.row_number().over(w)).select("doc_id", "iis_no", "pages", "labelled", "rank")
