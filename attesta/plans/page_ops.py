"""Queries of the token, comparison, word, box and image operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators import ocr, quality as q, spatial as s, tokens as k
from attesta.plans import text_ops as x
from attesta.sources.tables import table

# --- inputs -----------------------------------------------------------------------------------------------------------


def page_pairs(spark, d):
    """A page for each registry row, and a reading of it with the mistakes of cameras and of forgers, by row number."""
    r = table(spark, d, "registry")
    n, load = F.col("row_no"), F.col("load_no")
    money = F.format_number((n * 1234 + load).cast("bigint"), 2)
    sure = lambda c: F.coalesce(F.trim(c), F.lit("none"))
    lines = [
        F.lit("REPUBLIC OF THE ISLANDS OFFICE OF RECORDS"), F.concat(F.lit("Subject : "), sure("subject_name")), F.concat(F.lit("Company Name : "), sure("company_name")),
        F.concat(F.lit("Reference "), sure("iis_no"), F.lit(" dated "), F.date_format("first_seen", "yyyy-MM-dd"), F.lit(" and No. 25-0123")),
        F.concat(F.lit("Pay ₱"), money, F.lit(" within "), (n % 30 + 1).cast("string"), F.lit(" calendar days under Section IV and Rule 12 of the order")),
        F.concat(F.lit("- First item of the list for "), F.lower(sure("transaction_type"))), F.lit("- Second item of the list"), F.lit("1. Keep the copy 2. Return the original"), F.lit("MARIA SANTOS CRUZ"), F.lit("Regional Director of Records"),
    ]
    auth = F.concat_ws("\n", *lines)
    how = n % 13
    photo = (
        F.when(how == 0, F.replace(auth, F.lit("0"), F.lit("O"))).when(how == 1, F.regexp_replace(auth, r"₱[0-9]", "₱7")).when(how == 2, F.regexp_replace(auth, r"\n- First[^\n]*", "")).when(how == 3, F.lit("too few words"))
        .when(how == 4, F.reverse(auth)).when(how == 5, F.regexp_replace(auth, "Section IV", "Section IX")).when(how == 6, F.regexp_replace(auth, r"calendar days", "days")).when(how == 7, F.regexp_replace(auth, "Return the original", "Burn the original"))
        .when(how == 8, F.regexp_replace(auth, "Regional Director of Records", "Acting Clerk of Nothing")).when(how == 9, F.concat(auth, F.lit("\nP500 more"))).when(how == 10, F.regexp_replace(auth, "dated [0-9]{4}", "dated 1999")).when(how == 11, F.replace(auth, F.lit("Company Name :"), F.lit("+ Company Name ;"))).otherwise(auth)
    )
    return r.select(F.concat_ws("/", "load_no", "row_no").alias("pair_id"), photo.alias("ocr_text"), auth.alias("auth_text"), "load_no", "row_no", "iis_no")


def auth_pages(spark, d):
    return page_pairs(spark, d).select("pair_id", F.col("auth_text").alias("text"))


def word_rows(spark, d):
    """The words of the corpus as recognised words, eight a line."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(t.canonicalize(F.col("text")), " ")).alias("p", "text"))
    x0, y0 = (F.col("p") % 8 * 60).cast("double"), (F.floor(F.col("p") / 8) * 20 + F.col("p") % 3).cast("double")
    conf = ((F.col("doc_id") * 7 + F.col("p") * 13) % 100) / 100.0
    return w.select(F.col("doc_id").alias("image_id"), F.col("p").alias("seq"), "text", conf.alias("confidence"), x0.alias("x0"), y0.alias("y0"), (x0 + 50).alias("x1"), (y0 + 12 + F.col("p") % 2).alias("y1"))


SQL_WORDS = f"""SELECT doc_id AS image_id, p AS seq, text, ((doc_id * 7 + p * 13) % 100) / 100.0 AS confidence, CAST(p % 8 * 60 AS DOUBLE) AS x0, CAST(p // 8 * 20 + p % 3 AS DOUBLE) AS y0, p % 8 * 60 + 50.0 AS x1, p // 8 * 20 + p % 3 + 12.0 + p % 2 AS y1
  FROM (SELECT doc_id, unnest(ws) AS text, unnest(range(0, len(ws))) AS p FROM (SELECT doc_id, string_split({x.canon('text')}, ' ') AS ws FROM documents))"""


def boxes(spark, d):
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    kind = F.when(p % 4 == 0, "text").when(p % 4 == 1, "image").otherwise("graphic")
    x0, y0 = (p * 37 % 560).cast("double"), (o * 13 % 800).cast("double")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), (o * 10 + F.col("l_linenumber")).alias("seq"), kind.alias("kind"), F.when(p % 4 == 0, F.concat(F.lit("t"), (p % 50).cast("string"))).alias("text"), (p % 4 == 2).alias("rule"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 10).alias("y1"))


def page_sizes(spark, d):
    return boxes(spark, d).select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(842.0))


SQL_BOXES = """SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey * 10 + l_linenumber AS seq, CASE l_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'graphic' END AS kind, CASE WHEN l_partkey % 4 = 0 THEN 't' || l_partkey % 50 END AS text, l_partkey % 4 = 2 AS rule,
  CAST(l_partkey * 37 % 560 AS DOUBLE) AS x0, CAST(l_orderkey * 13 % 800 AS DOUBLE) AS y0, l_partkey * 37 % 560 + l_quantity AS x1, l_orderkey * 13 % 800 + 10.0 AS y1 FROM lineitem"""
SQL_SIZES = f"SELECT DISTINCT doc_id, page_no, 595.0 AS page_w, 842.0 AS page_h FROM ({SQL_BOXES})"


def part_boxes(spark, d):
    """Boxes on the pages of 50 documents, in the left part of the page."""
    p = F.col("p_partkey")
    x0, y0 = (p * 31 % 340).cast("double"), (p * 17 % 830).cast("double")
    return table(spark, d, "part").select(F.col("p_size").alias("doc_id"), (p % 3 + 1).cast("int").alias("page_no"), F.when(p % 5 == 0, "graphic").otherwise("text").alias("kind"), (p % 5 == 0).alias("rule"), x0.alias("x0"), y0.alias("y0"), (x0 + p % 90 + 5).alias("x1"), (y0 + 9).alias("y1"))


SQL_PART = "SELECT p_size AS doc_id, CAST(p_partkey % 3 + 1 AS INTEGER) AS page_no, CASE WHEN p_partkey % 5 = 0 THEN 'graphic' ELSE 'text' END AS kind, p_partkey % 5 = 0 AS rule, CAST(p_partkey * 31 % 340 AS DOUBLE) AS x0, CAST(p_partkey * 17 % 830 AS DOUBLE) AS y0, p_partkey * 31 % 340 + p_partkey % 90 + 5.0 AS x1, p_partkey * 17 % 830 + 9.0 AS y1 FROM part"


def pixels(spark, d):
    """A grey image of 40 by 30 pixels for each supplier."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29))))
    i = F.col("image_id")
    v = F.when(i % 5 == 0, 20 + F.col("x") % 3).when(i % 5 == 1, 250 - F.col("y") % 4).otherwise((F.col("x") * 7 + F.col("y") * 13 * (i % 9 + 1)) % 256)
    return p.withColumn("v", v.cast("int"))


SQL_PIXELS = "SELECT image_id, x, y, CAST(CASE image_id % 5 WHEN 0 THEN 20 + x % 3 WHEN 1 THEN 250 - y % 4 ELSE (x * 7 + y * 13 * (image_id % 9 + 1)) % 256 END AS INTEGER) AS v FROM (SELECT s_suppkey AS image_id, unnest(range(0, 40)) AS x FROM supplier), (SELECT unnest(range(0, 30)) AS y)"


def gray_images(spark, d):
    """The pixels of `pixels` as arrays, for the operators over whole images."""
    rows = pixels(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return rows.select("image_id", F.lit(40).alias("width"), F.lit(30).alias("height"), F.unhex(F.array_join(F.transform("p", lambda e: F.lpad(F.hex(e["v"]), 2, "0")), "")).alias("gray"))


def corpus_tokens(spark, d, photo):
    """Words of the corpus as tokens; the photo lost every seventh and reads 1 as l."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(t.canonicalize(F.col("text")), " ")).alias("seq", "value"))
    w = w.filter(F.col("seq") % 7 != 6).withColumn("value", F.translate("value", "1", "l")) if photo else w
    return w.withColumn("match_key", t.match_key(F.lit("date"), F.col("value")))


def items(spark, d, photo):
    v = F.concat(F.lit("Item of "), F.date_format("l_shipdate", "yyyy"), F.lit(" clause "), F.col("l_partkey").cast("string"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.monotonically_increasing_id().alias("_m"), (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("seq"), (F.col("l_linenumber") % 5).cast("string").alias("number"), v.alias("value"), F.col("l_linenumber").alias("line")).drop("_m")
    if not photo:
        return i
    altered = F.when(F.col("seq") % 4 == 0, F.concat("value", F.lit(" more"))).when(F.col("seq") % 4 == 1, F.replace("value", F.lit("clause"), F.lit("dause"))).when(F.col("seq") % 4 == 2, F.lit("Other text")).otherwise(F.col("value"))
    return i.withColumn("number", F.when(F.col("seq") % 9 == 0, "9").otherwise(F.col("number"))).withColumn("value", altered)


# --- queries ----------------------------------------------------------------------------------------------------------


def _tokens_of(cls):
    def run(spark, d):
        return k.page_tokens(auth_pages(spark, d)).filter(F.col("cls") == cls).select("pair_id", "line", "value", F.coalesce("label", "number", F.lit("")).alias("mark"))

    return run


ref_e1_list_items, ref_e2_numbered_items, ref_e3_money, ref_e6_references = map(_tokens_of, ("listItem", "numberedItem", "money", "reference"))
ref_e7_citations, ref_e9_fields, ref_e10_signatory_title = map(_tokens_of, ("citation", "field", "signatoryTitle"))


def _plain(cls):
    def run(spark, d):
        return k.plain_tokens(auth_pages(spark, d), cls).groupBy("pair_id", "line", "value").agg(F.count("*").alias("n"))

    return run


ref_e4_dates, ref_e5_durations, ref_e8_names = map(_plain, ("date", "duration", "name"))


def ref_e9_photo_fields(spark, d):
    p = page_pairs(spark, d).select("pair_id", "ocr_text", "auth_text")
    return k.page_tokens(p, "ocr_text", "auth_text").filter("cls = 'field'").select("pair_id", "line", "label", "value")


def ref_a4_lcs(spark, d):
    p = page_pairs(spark, d)
    a, b = t.words(F.col("ocr_text")), t.words(F.col("auth_text"))
    return p.select("pair_id", k.lcs_udf(a, b).alias("lcs"), F.round(k.similarity_columns(a, b), 6).alias("similarity"))


def ref_f4_page_gates(spark, d):
    return k.compare_pages(page_pairs(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.min("similarity"), 4).alias("least"))


def ref_j4_multiset_match(spark, d):
    return k.multiset_surplus(corpus_tokens(spark, d, False), corpus_tokens(spark, d, True), ["doc_id"]).select("doc_id", "seq", "value")


def ref_j5_nearest(spark, d):
    p = page_pairs(spark, d)
    record = k.page_tokens(p.select("pair_id", F.col("auth_text").alias("text")))
    photo = k.page_tokens(p.select("pair_id", "ocr_text", "auth_text"), "ocr_text", "auth_text")
    left = k.multiset_surplus(record.filter("cls NOT IN ('numberedItem', 'signatoryTitle')"), photo, ["pair_id"])
    return k.nearest_tokens(left, record, photo, "pair_id")


def ref_j6_numbered_join(spark, d):
    return k.numbered_join(items(spark, d, False), items(spark, d, True), "pair_id").withColumn("line", F.coalesce("line", F.lit(0)))


def ref_e11_compare(spark, d):
    r = k.compare_pages(page_pairs(spark, d))
    return r.select("pair_id", "status", F.round("similarity", 6).alias("similarity"), F.to_json("findings").alias("findings"), "suppressed")


def ref_j7_title_findings(spark, d):
    f = k.compare_pages(page_pairs(spark, d)).select("pair_id", F.explode("findings").alias("f"))
    return f.filter("f.cls = 'signatoryTitle'").select("pair_id", "f.severity", "f.expected", "f.found", "f.reason")


def ref_a7_suppressed(spark, d):
    return k.compare_pages(page_pairs(spark, d)).groupBy("status", "suppressed").agg(F.count("*").alias("n"))


def ref_p30_shown_findings(spark, d):
    return k.shown_findings(k.compare_pages(page_pairs(spark, d)))


def ref_s2_page_texts(spark, d):
    """Text items joined by one space, and with line ends kept (S2, S3): items are the recognised words, the eighth of a line ends it."""
    w = word_rows(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("ws"))
    sep = lambda e, i: F.when(i == F.size("ws") - 1, "").when(e["seq"] % 8 == 7, "\n").otherwise(" ")
    return w.select("image_id", F.array_join(F.transform("ws", lambda e: e["text"]), " ").alias("text"), F.array_join(F.transform("ws", lambda e, i: F.concat(e["text"], sep(e, i))), "").alias("text_lines"))


def ref_s5a_flat_words(spark, d):
    rows = word_rows(spark, d).groupBy("image_id", F.floor(F.col("seq") / 8).alias("l")).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("words"))
    trees = rows.groupBy("image_id").agg(F.array(F.struct(F.array(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("l", "words"))), lambda e: F.struct(e["words"].alias("words"))).alias("lines"))).alias("paragraphs"))).alias("blocks"))
    return trees.select("image_id", F.array_join(F.transform(ocr.flat_words(F.col("blocks")), lambda w: w["text"]), " ").alias("words"))


def ref_a6_confidence(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), (F.col("doc_id") % 130).cast("double").alias("page_confidence"))
    return ocr.content_confidence(word_rows(spark, d), pages).select("image_id", F.round("mean_confidence", 12).alias("mean_confidence"))


def ref_a8_median_height(spark, d):
    return ocr.median_height(word_rows(spark, d))


def ref_a12_union_box(spark, d):
    return ocr.union_boxes(word_rows(spark, d), ["image_id"])


def ref_w2_line_clusters(spark, d):
    return ocr.word_lines(word_rows(spark, d))


def footer_pages(spark, d):
    """Pages of the pairs as recognised words, with a footer line at the bottom."""
    p = page_pairs(spark, d).select("pair_id", "row_no", F.concat("ocr_text", F.lit("\nForm R1-2026-000123 copy")).alias("text"))
    w = p.select("pair_id", "row_no", F.posexplode(F.split("text", "\n")).alias("l", "s")).select("pair_id", "row_no", "l", F.posexplode(F.split("s", " ")).alias("i", "text")).filter("text <> ''")
    x0, y0 = (F.col("i") * 50).cast("double"), (F.col("l") * 20).cast("double")
    conf = F.when(F.col("row_no") % 4 == 0, 0.3).otherwise(0.9)
    return p, w.select(F.col("pair_id").alias("image_id"), (F.col("l") * 100 + F.col("i")).alias("seq"), "text", conf.alias("confidence"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 12).alias("y1"))


def ref_w3_footer(spark, d):
    p, w = footer_pages(spark, d)
    return p.join(ocr.word_arrays(w).withColumnRenamed("image_id", "pair_id"), "pair_id").select("pair_id", ocr.footer_udf("text", "words").alias("text"))


def ref_j8_locate(spark, d):
    _, w = footer_pages(spark, d)
    c = k.compare_pages(page_pairs(spark, d)).filter("size(findings) > 0").withColumnRenamed("pair_id", "image_id")
    r = c.join(ocr.word_arrays(w), "image_id").select("image_id", F.posexplode(ocr.locate_udf("findings", "words")).alias("finding", "r"))
    return r.filter("r IS NOT NULL").select("image_id", "finding", "r.*")


def ref_e12_verify_images(spark, d):
    p, w = footer_pages(spark, d)
    size = F.size(F.filter(F.split("ocr_text", r"\s+"), lambda x: x != ""))
    req = page_pairs(spark, d).select(F.col("pair_id").alias("image_id"), F.coalesce("iis_no", F.lit("")).alias("iis_no"), F.lit(1).alias("k"), "ocr_text", F.when(F.col("row_no") % 10 == 9, 0.4).otherwise(0.9).alias("mean_confidence"), size.alias("word_count"), "auth_text")
    rec = req.filter("iis_no <> ''").groupBy("iis_no", "k").agg(F.min("auth_text").alias("auth_text"))
    r = ocr.verify_page_images(req.drop("auth_text"), rec, w)
    return r.select("image_id", "iis_no", "k", "status", F.round("similarity", 6).alias("similarity"), F.to_json("findings").alias("findings"), "suppressed")


def ref_f5_drop_faint(spark, d):
    f = ref_e12_verify_images(spark, d)
    return f.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("findings")).alias("letters"))


def ref_a16_calibration(spark, d):
    p = page_pairs(spark, d)
    r = k.compare_pages(p).join(p.select("pair_id", F.when(F.col("row_no") % 13 == 12, "genuine").when(F.col("row_no") % 13 == 4, "other").otherwise("altered").alias("label")), "pair_id")
    return ocr.calibration(r).select("label", "n_images", F.round("floor", 4).alias("floor"), F.round("ceiling", 4).alias("ceiling"), "n_material")


def ref_s6a_text_boxes(spark, d):
    i = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("str"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 800).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(8.0).alias("height"))
    return s.text_boxes(i)


def ref_s6_drawn_boxes(spark, d):
    o = table(spark, d, "lineitem")
    op = F.element_at(F.array(*[F.lit(v) for v in ("save", "transform", "image", "path", "restore", "path", "clip")]), F.col("l_linenumber"))
    args = F.when(op == "transform", F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.col("l_quantity"), F.lit(5.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.col("l_quantity"), F.lit(2.0)))
    ops = o.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("seq"), op.alias("op"), args.alias("args"))
    return s.drawn_boxes(ops)


def ref_p29_seal_rects(spark, d):
    w = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10 + 200).cast("double").alias("w"))
    r = w.select("p_partkey", s.seal_rect(F.col("w")).alias("r"), s.seal_block(F.col("w")).alias("b"))
    return r.select("p_partkey", *[F.round(f"r.{c}", 4).alias(f"mark_{c}") for c in ("x0", "y0", "x1", "y1")], *[F.round(f"b.{c}", 4).alias(f"block_{c}") for c in ("x0", "y0", "x1", "y1")])


def ref_j9_overlap(spark, d):
    return s.seal_hits(boxes(spark, d), page_sizes(spark, d)).select("doc_id", "page_no", "seq", "kind")


def ref_a13_seal_fit(spark, d):
    f = s.seal_fit(boxes(spark, d), page_sizes(spark, d))
    return f.select("doc_id", "page_no", "clear", F.array_join("covered", " ").alias("covered"), "images", "shapes", "rules")


def ref_a13_document_fit(spark, d):
    f = s.document_fit(s.seal_fit(boxes(spark, d), page_sizes(spark, d)))
    return f.select("doc_id", "clear", F.array_join(F.transform("ruled", lambda p: p.cast("string")), ",").alias("ruled"))


def ref_a17_blocked_text(spark, d):
    return s.blocked_text(s.seal_fit(boxes(spark, d), page_sizes(spark, d)))


def ref_a14_clear_spot(spark, d):
    b = part_boxes(spark, d)
    sizes = b.select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(842.0))
    return s.clear_spots(b, sizes).select("doc_id", "found", F.coalesce("x0", F.lit(-1.0)).alias("x0"), F.coalesce("y0", F.lit(-1.0)).alias("y0"), F.coalesce("moved_by", F.lit(-1)).alias("moved_by"), "tried")


def ref_j10_free_spots(spark, d):
    b = part_boxes(spark, d)
    sizes = b.select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(842.0))
    return s.free_spots(b, s.grid_spots(sizes)).select("doc_id", "x0", "y0")


def ref_a11_local_levels(spark, d):
    return q.local_levels(pixels(spark, d), 3, 6.0).select("image_id", "x", "y", F.round("level", 4).alias("level"))


def ref_k16_crop(spark, d):
    box = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(5).alias("x0"), (F.col("s_suppkey") % 7).cast("int").alias("y0"), F.lit(12).alias("x1"), F.lit(11).alias("y1"))
    return q.cropped(pixels(spark, d), box)


def ref_p28_cover_crop(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("fw"), (F.col("p_partkey") % 900 + 100).alias("fh"), (F.col("p_partkey") % 7 * 50).alias("bw"), F.lit(200).alias("bh"))
    return p.select("p_partkey", s.cover_crop(F.col("fw"), F.col("fh"), F.col("bw"), F.col("bh")).alias("c")).select("p_partkey", *[F.round(f"c.{n}", 4).alias(n) for n in ("sx", "sy", "sw", "sh")])


def ref_a9_blur(spark, d):
    return q.pixel_blur(pixels(spark, d)).select("image_id", F.round("variance", 4).alias("variance"))


def ref_a9_blur_arrays(spark, d):
    return gray_images(spark, d).select("image_id", F.round(q.blur_udf("gray", "width", "height"), 4).alias("variance"))


def ref_f6_exposure(spark, d):
    return q.pixel_exposure(pixels(spark, d))


def ref_f7_capture_quality(spark, d):
    return q.capture_quality(pixels(spark, d))


def ref_a10_otsu(spark, d):
    return q.otsu(pixels(spark, d))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("ref_") and callable(f)}

# --- SQL --------------------------------------------------------------------------------------------------------------

_AUTH = f"""SELECT load_no || '/' || row_no AS pair_id, concat_ws(chr(10), 'REPUBLIC OF THE ISLANDS OFFICE OF RECORDS', 'Subject : ' || coalesce(trim(subject_name), 'none'), 'Company Name : ' || coalesce(trim(company_name), 'none'),
  'Reference ' || coalesce(trim(iis_no), 'none') || ' dated ' || strftime(first_seen AT TIME ZONE 'UTC', '%Y-%m-%d') || ' and No. 25-0123',
  'Pay ₱' || format('{{:,}}', CAST(row_no AS BIGINT) * 1234 + load_no) || '.00 within ' || (row_no % 30 + 1) || ' calendar days under Section IV and Rule 12 of the order',
  '- First item of the list for ' || lower(coalesce(trim(transaction_type), 'none')), '- Second item of the list', '1. Keep the copy 2. Return the original', 'MARIA SANTOS CRUZ', 'Regional Director of Records') AS text FROM registry"""


def _sql_plain(cls: str) -> str:
    pattern = k.SHAPES[cls].pattern.replace("'", "''")
    flags = "(?i)" if cls != "name" else ""
    return f"""SELECT pair_id, CAST(line AS INTEGER) AS line, value, count(*) AS n FROM (SELECT pair_id, line, unnest(regexp_extract_all({x.strip('raw')}, '{flags}(?:{pattern})')) AS value
      FROM (SELECT pair_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT pair_id, string_split(text, chr(10)) AS ls FROM ({_AUTH})))) GROUP BY 1, 2, 3"""


_W, _H = s.block_size()
_SIZE = s.seal_size()


def _meet(x0, y0, x1, y1):
    return f"b.x0 < {x1} - {s.TOUCH} AND b.x1 > {x0} + {s.TOUCH} AND b.y0 < {y1} - {s.TOUCH} AND b.y1 > {y0} + {s.TOUCH}"


_Y = s.BASELINE - s.GAP - s.LINE_SIZE
_HITS = f"SELECT b.* FROM ({SQL_BOXES}) b JOIN ({SQL_SIZES}) p ON b.doc_id = p.doc_id AND b.page_no = p.page_no WHERE {_meet(f'(page_w - {s.MARGIN} - {_W})', _Y, f'(page_w - {s.MARGIN})', _Y + _H)}"
_FIT = f"""SELECT p.doc_id, p.page_no, coalesce(covered, '') = '' AND coalesce(images, 0) = 0 AND coalesce(shapes, 0) = 0 AS clear, coalesce(covered, '') AS covered, coalesce(images, 0) AS images, coalesce(shapes, 0) AS shapes, coalesce(rules, 0) AS rules FROM ({SQL_SIZES}) p
  LEFT JOIN (SELECT doc_id, page_no, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'graphic' AND NOT rule) AS shapes, count(*) FILTER (kind = 'graphic' AND rule) AS rules FROM hits GROUP BY 1, 2) h ON h.doc_id = p.doc_id AND h.page_no = p.page_no
  LEFT JOIN (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY seq) AS covered FROM (SELECT doc_id, page_no, text, min(seq) AS seq FROM hits WHERE kind = 'text' GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.doc_id = p.doc_id AND c.page_no = p.page_no"""
_FIT = f"WITH hits AS ({_HITS}), fit AS ({_FIT})"
_ITEM = "SELECT l_orderkey AS pair_id, l_partkey * 100 + l_suppkey % 100 AS seq, CAST(l_linenumber % 5 AS VARCHAR) AS number, 'Item of ' || strftime(l_shipdate, '%Y') || ' clause ' || l_partkey AS value, l_linenumber AS line FROM lineitem"
_ITEM2 = f"SELECT pair_id, seq, CASE WHEN seq % 9 = 0 THEN '9' ELSE number END AS number, CASE seq % 4 WHEN 0 THEN value || ' more' WHEN 1 THEN replace(value, 'clause', 'dause') WHEN 2 THEN 'Other text' ELSE value END AS value, line FROM ({_ITEM})"
_NK = "replace(replace(replace(lower(translate({0}, '" + t.GLYPHS[0] + "', '" + t.GLYPHS[1] + "')), 'rn', 'm'), 'cl', 'd'), 'vv', 'w')"
_LAP = f"SELECT image_id, 4.0 * v - lag(v) OVER r - lead(v) OVER r - lag(v) OVER c - lead(v) OVER c AS lap FROM ({SQL_PIXELS}) WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"
_EXP = f"SELECT image_id, CASE WHEN avg(v) < 60 OR count(*) FILTER (v < 10) / count(*) > 0.5 THEN 'dark' WHEN avg(v) > 235 OR count(*) FILTER (v > 245) / count(*) > 0.5 THEN 'bright' ELSE 'none' END AS exposure FROM ({SQL_PIXELS}) GROUP BY 1"
_TOK = f"SELECT doc_id, seq, value, lower({x.fold('value')}) AS kk FROM (SELECT doc_id, unnest(ws) AS value, unnest(range(0, len(ws))) AS seq FROM (SELECT doc_id, string_split({x.canon('text')}, ' ') AS ws FROM documents))"

SQL = {
    "ref_e4_dates": _sql_plain("date"),
    "ref_e5_durations": _sql_plain("duration"),
    "ref_e8_names": _sql_plain("name"),
    "ref_j4_multiset_match": f"""WITH a AS (SELECT doc_id, seq, value, regexp_replace(kk, '^(?:php|p)\\s?', '₱') AS kk FROM ({_TOK})), b AS (SELECT doc_id, kk, count(*) AS n FROM a WHERE seq % 7 <> 6 GROUP BY 1, 2)
      SELECT doc_id, seq, value FROM (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id, a.kk ORDER BY seq) AS rn, coalesce(n, 0) AS n FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.kk = b.kk) WHERE rn > n""",
    "ref_j6_numbered_join": f"""WITH a AS (SELECT pair_id, number, unnest(max({{q: seq, value: value, line: line}})) FROM ({_ITEM}) GROUP BY 1, 2), b AS (SELECT pair_id, number, unnest(max({{q: seq, value: value, line: line}})) FROM ({_ITEM2}) GROUP BY 1, 2),
      j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.number, b.number) AS number, a.line, a.value AS expected, b.value AS found, string_split({_NK.format('a.value')}, ' ') AS x, string_split({_NK.format('b.value')}, ' ') AS y FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.number = b.number)
      SELECT pair_id, number, CASE WHEN found IS NULL THEN 'tolerant' ELSE 'material' END AS severity, coalesce(line, 0) AS line, expected, found, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'added' ELSE 'text' END AS reason FROM j
      WHERE found IS NULL OR expected IS NULL OR list_slice(x, 1, least(len(x), len(y))) <> list_slice(y, 1, least(len(x), len(y)))""",
    "ref_s2_page_texts": f"SELECT image_id, string_agg(text, ' ' ORDER BY seq) AS text, string_agg(text || CASE WHEN seq = m THEN '' WHEN seq % 8 = 7 THEN chr(10) ELSE ' ' END, '' ORDER BY seq) AS text_lines FROM (SELECT *, max(seq) OVER (PARTITION BY image_id) AS m FROM ({SQL_WORDS})) GROUP BY 1",
    "ref_s5a_flat_words": f"SELECT image_id, string_agg(text, ' ' ORDER BY seq) AS words FROM ({SQL_WORDS}) GROUP BY 1",
    "ref_a6_confidence": f"SELECT d.doc_id AS image_id, round(coalesce(c, greatest(0.0, least(1.0, CAST(d.doc_id % 130 AS DOUBLE) / 100))), 12) AS mean_confidence FROM documents d LEFT JOIN (SELECT image_id, avg(CAST(confidence AS DOUBLE)) AS c FROM ({SQL_WORDS}) WHERE regexp_matches(text, '[a-zA-Z0-9]{{2,}}') GROUP BY 1) w ON w.image_id = d.doc_id",
    "ref_a8_median_height": f"SELECT image_id, list_sort(list(CAST(y1 - y0 AS DOUBLE)))[count(*) // 2 + 1] AS median_height FROM ({SQL_WORDS}) WHERE trim(text) <> '' GROUP BY 1",
    "ref_a12_union_box": f"SELECT image_id, min(x0) AS x0, min(y0) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM ({SQL_WORDS}) GROUP BY 1",
    "ref_s6a_text_boxes": "SELECT p_partkey AS doc_id, 'text' AS kind, trim(p_name) AS text, false AS rule, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 800 - 2.0 AS DOUBLE) AS y0, CAST(p_size + 30.0 AS DOUBLE) AS x1, CAST(p_partkey % 800 + 6.8 AS DOUBLE) AS y1 FROM part WHERE p_partkey % 7 <> 0",
    "ref_p29_seal_rects": f"""SELECT p_partkey, round(w - {s.MARGIN} - {_SIZE}, 4) AS mark_x0, CAST({s.BASELINE} AS DOUBLE) AS mark_y0, w - {s.MARGIN} AS mark_x1, round({s.BASELINE} + {_SIZE}, 4) AS mark_y1, round(w - {s.MARGIN} - {_W}, 4) AS block_x0, CAST({_Y} AS DOUBLE) AS block_y0, w - {s.MARGIN} AS block_x1, round({_Y} + {_H}, 4) AS block_y1
      FROM (SELECT p_partkey, CAST(p_size * 10 + 200 AS DOUBLE) AS w FROM part)""",
    "ref_j9_overlap": f"SELECT doc_id, page_no, seq, kind FROM ({_HITS})",
    "ref_a13_seal_fit": _FIT + " SELECT * FROM fit",
    "ref_a13_document_fit": _FIT + " SELECT doc_id, bool_and(clear) AS clear, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (clear AND rules > 0), '') AS ruled FROM fit GROUP BY 1",
    "ref_a17_blocked_text": _FIT + """ SELECT doc_id, page_no, 'page ' || page_no || ': ' || concat_ws(', ', CASE WHEN covered <> '' THEN 'text “' || covered || '”' END, CASE WHEN images > 0 THEN images || ' image' || CASE WHEN images = 1 THEN '' ELSE 's' END END, CASE WHEN shapes > 0 THEN shapes || ' drawn shape' || CASE WHEN shapes = 1 THEN '' ELSE 's' END END) AS detail FROM fit WHERE NOT clear""",
    "ref_a14_clear_spot": f"""WITH docs AS (SELECT DISTINCT doc_id FROM ({SQL_PART})), sp AS (SELECT doc_id, CAST({s.EDGE} + i * {s.STEP} AS DOUBLE) AS x0, CAST({s.EDGE} + j * {s.STEP} AS DOUBLE) AS y0 FROM docs, (SELECT unnest(range(0, CAST(floor((595.0 - {2 * s.EDGE} - {_W}) / {s.STEP}) AS BIGINT) + 1)) AS i), (SELECT unnest(range(0, CAST(floor((842.0 - {2 * s.EDGE} - {_H}) / {s.STEP}) AS BIGINT) + 1)) AS j)),
      free AS (SELECT * FROM sp s WHERE NOT EXISTS (SELECT 1 FROM ({SQL_PART}) b WHERE b.doc_id = s.doc_id AND (kind <> 'graphic' OR NOT rule) AND (({_meet(f'(s.x0 + {_W - _SIZE} - {s.QUIET})', f'(s.y0 + {s.GAP + s.LINE_SIZE} - {s.QUIET})', f'(s.x0 + {_W} + {s.QUIET})', f'(s.y0 + {_H} + {s.QUIET})')}) OR ({_meet('s.x0', 's.y0', f'(s.x0 + {_W})', f'(s.y0 + {s.LINE_SIZE})')})))),
      best AS (SELECT doc_id, unnest(min({{d: sqrt((x0 - {595 - s.MARGIN - _W}) * (x0 - {595 - s.MARGIN - _W}) + (y0 - {_Y}) * (y0 - {_Y})), y0: y0, x0: x0}})) FROM free GROUP BY 1)
      SELECT t.doc_id, d IS NOT NULL AS found, coalesce(x0, -1.0) AS x0, coalesce(y0, -1.0) AS y0, coalesce(CAST(floor(d + 0.5) AS INTEGER), -1) AS moved_by, tried FROM (SELECT doc_id, count(*) AS tried FROM sp GROUP BY 1) t LEFT JOIN best ON best.doc_id = t.doc_id""",
    "ref_j10_free_spots": f"""WITH docs AS (SELECT DISTINCT doc_id FROM ({SQL_PART})), sp AS (SELECT doc_id, CAST({s.EDGE} + i * {s.STEP} AS DOUBLE) AS x0, CAST({s.EDGE} + j * {s.STEP} AS DOUBLE) AS y0 FROM docs, (SELECT unnest(range(0, CAST(floor((595.0 - {2 * s.EDGE} - {_W}) / {s.STEP}) AS BIGINT) + 1)) AS i), (SELECT unnest(range(0, CAST(floor((842.0 - {2 * s.EDGE} - {_H}) / {s.STEP}) AS BIGINT) + 1)) AS j)),
      free AS (SELECT * FROM sp s WHERE NOT EXISTS (SELECT 1 FROM ({SQL_PART}) b WHERE b.doc_id = s.doc_id AND (kind <> 'graphic' OR NOT rule) AND (({_meet(f'(s.x0 + {_W - _SIZE} - {s.QUIET})', f'(s.y0 + {s.GAP + s.LINE_SIZE} - {s.QUIET})', f'(s.x0 + {_W} + {s.QUIET})', f'(s.y0 + {_H} + {s.QUIET})')}) OR ({_meet('s.x0', 's.y0', f'(s.x0 + {_W})', f'(s.y0 + {s.LINE_SIZE})')})))) SELECT doc_id, x0, y0 FROM free""",
    "ref_a11_local_levels": f"""SELECT image_id, x, y, round(sum(s) OVER c / CAST(sum(n) OVER c AS DOUBLE) - 6.0, 4) AS level FROM (SELECT image_id, x, y, sum(v) OVER r AS s, count(*) OVER r AS n FROM ({SQL_PIXELS}) WINDOW r AS (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
      WINDOW c AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "ref_k16_crop": f"SELECT image_id, CAST(x - 5 AS INTEGER) AS x, CAST(y - image_id % 7 AS INTEGER) AS y, v FROM ({SQL_PIXELS}) WHERE x BETWEEN 5 AND 12 AND y BETWEEN image_id % 7 AND 11",
    "ref_e1_list_items": "SELECT load_no || '/' || row_no AS pair_id, l AS line, CASE l WHEN 6 THEN trim('First item of the list for ' || " + x.canon("lower(coalesce(trim(transaction_type), 'none'))") + ") ELSE 'Second item of the list' END AS value, '' AS mark FROM registry, (SELECT unnest([6, 7]) AS l)",
    "ref_e2_numbered_items": "SELECT load_no || '/' || row_no AS pair_id, 8 AS line, 'Keep the copy' AS value, '1' AS mark FROM registry",
    "ref_e3_money": "SELECT load_no || '/' || row_no AS pair_id, 5 AS line, '₱' || format('{:,}', CAST(row_no AS BIGINT) * 1234 + load_no) || '.00' AS value, '' AS mark FROM registry",
    "ref_e6_references": "SELECT load_no || '/' || row_no AS pair_id, 4 AS line, regexp_extract(trim(iis_no), '\\bR1-[0-9]{4}-[0-9]{6}\\b', 0) AS value, '' AS mark FROM registry WHERE regexp_matches(trim(iis_no), '\\bR1-[0-9]{4}-[0-9]{6}\\b') UNION ALL SELECT load_no || '/' || row_no, 4, 'No. 25-0123', '' FROM registry",
    "ref_e7_citations": "SELECT load_no || '/' || row_no AS pair_id, 5 AS line, v AS value, '' AS mark FROM registry, (SELECT unnest(['Section IV', 'Rule 12']) AS v)",
    "ref_e10_signatory_title": "SELECT load_no || '/' || row_no AS pair_id, 10 AS line, 'Regional Director of Records' AS value, '' AS mark FROM registry",
    "ref_e9_fields": f"SELECT * FROM (SELECT load_no || '/' || row_no AS pair_id, l AS line, {x.canon("CASE l WHEN 2 THEN coalesce(trim(subject_name), 'none') ELSE coalesce(trim(company_name), 'none') END")} AS value, CASE l WHEN 2 THEN 'Subject' ELSE 'Company Name' END AS mark FROM registry, (SELECT unnest([2, 3]) AS l)) WHERE value <> '' AND NOT regexp_matches(value, '" + k.SHAPES["name"].pattern.replace("'", "''") + "')",
    "ref_p28_cover_crop": """SELECT p_partkey, round((fw - sw) / 2, 4) AS sx, round((fh - sh) / 2, 4) AS sy, round(sw, 4) AS sw, round(sh, 4) AS sh FROM (SELECT *, CASE WHEN bw = 0 OR fw * 200 <= fh * bw THEN fw ELSE fh * bw / 200 END AS sw, CASE WHEN bw = 0 OR fw * 200 > fh * bw THEN fh ELSE fw * 200 / bw END AS sh
      FROM (SELECT p_partkey, CAST(p_size * 20 AS DOUBLE) AS fw, CAST(p_partkey % 900 + 100 AS DOUBLE) AS fh, CAST(p_partkey % 7 * 50 AS DOUBLE) AS bw FROM part))""",
    "ref_a9_blur": f"SELECT image_id, round(coalesce(var_pop(lap), 0), 4) AS variance FROM ({_LAP}) GROUP BY 1",
    "ref_a9_blur_arrays": f"SELECT image_id, round(coalesce(var_pop(lap), 0), 4) AS variance FROM ({_LAP}) GROUP BY 1",
    "ref_f6_exposure": _EXP,
    "ref_f7_capture_quality": f"SELECT e.image_id, v < 50 AS blurry, exposure FROM ({_EXP}) e JOIN (SELECT image_id, coalesce(var_pop(lap), 0) AS v FROM ({_LAP}) GROUP BY 1) b ON b.image_id = e.image_id",
    "ref_a10_otsu": f"""WITH h AS (SELECT image_id, v, count(*) AS c FROM ({SQL_PIXELS}) GROUP BY 1, 2), r AS (SELECT image_id, v, sum(c) OVER w AS wb, sum(c * v) OVER w AS sb, sum(c) OVER a AS n, sum(c * v) OVER a AS t FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
      b AS (SELECT image_id, v, CASE WHEN n > wb THEN round(CAST(wb AS DOUBLE) * (n - wb) * pow(CAST(sb AS DOUBLE) / wb - CAST(t - sb AS DOUBLE) / (n - wb), 2), 3) ELSE 0 END AS g FROM r)
      SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g DESC, v) AS rn FROM b) WHERE rn = 1""",
}
