"""Golden cases of the core operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.functions import seals, text as t
from attesta.operators import integrity as i, registry as r
from tests.conftest import SF

KEYS = {"1": "test-secret"}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,kind,key",
    [
        ("R1-2025-028799", "iis_no", "R1-2025-028799"), ("EMBR1-2025-030436", "iis_no", "R1-2025-030436"), ("embr1-2025-030436", "iis_no", "R1-2025-030436"), ("13081688c1eb0a6ab8-69-2025-09-16-69-2025-09-30", "token", "13081688c1eb0a6ab8-69-2025-09-16-69-2025-09-30"),
        ("https://x.example/a/13081688c1eb0a6ab8-69?q=1#z", "token", "13081688c1eb0a6ab8-69"), ("https://x.example/R1-2025-028799/view", "iis_no", "R1-2025-028799"), ("   ", "unknown", ""), (None, "unknown", ""), ("hello", "unknown", "hello"),
    ],
)
def test_normalize(spark, raw, kind, key):
    x = one(spark, t.normalize_id(F.lit(raw).cast("string")))
    assert (x.kind, x.lookup_key) == (kind, key)


def test_seal_of_the_golden_page(spark):
    d = seals.page_digest(F.lit(" Page  one\nbody. "))
    assert one(spark, seals.seal(KEYS, F.lit("1"), F.lit("R1-2026-000001"), F.lit(1), F.lit(3), d)) == "W5FB-P5CD"
    assert one(spark, seals.seal(KEYS, F.lit("9"), F.lit("R1-2026-000001"), F.lit(1), F.lit(3), d)) is None
    long = {"1": "k" * 100}
    import base64, hashlib, hmac  # noqa: E401

    want = base64.b32encode(hmac.new(b"k" * 100, b"a|1|2|d", hashlib.sha256).digest())[:8].decode()
    assert one(spark, seals.seal(long, F.lit("1"), F.lit("a"), F.lit(1), F.lit(2), F.lit("d"))) == f"{want[:4]}-{want[4:]}"


def test_folds(spark):
    assert [one(spark, t.fold_glyphs(F.lit(x))) for x in ("5O,OOO", "l5", "B2", "45")] == ["50,000", "15", "82", "45"]
    assert one(spark, t.words(F.lit("Body  text.\nEMB · R1-2026-000001 · p1/3 · K1 · W5FB-P5CD"))) == ["body", "text."]
    assert one(spark, t.canonicalize(F.lit(" a﻿ b "))) == "a b"


@pytest.mark.parametrize("url,ok", [("https://registry.example/x", True), ("http://REGISTRY.example", True), ("https://registry.example.evil/x", False), ("https://registry.example@evil.example/", False), ("ftp://registry.example/", False), ("no url", False), (None, False)])
def test_may_fetch(spark, url, ok):
    assert one(spark, t.may_fetch(F.lit(url).cast("string"), F.lit("https://registry.example"))) is ok


def test_upsert_and_metrics(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(" R1-1 ", "a", at), ("", "b", at), ("R1-2", "c", at), ("R1-2", "d", at)]
    batch = spark.createDataFrame([(n, v, *["x"] * 5, ts, k) for k, (n, v, ts) in enumerate(rows)], "iis_no string, subject_name string, company_name string, address string, emb_id string, transaction_type string, attachment_ref string, at timestamp, k int")
    empty = spark.createDataFrame([], r.DOCUMENTS)
    assert tuple(r.ingest_metrics(batch, empty).first()) == (2, 1, 3)
    docs = r.merge_batch(empty, batch, [F.col("k")])
    assert sorted((x.iis_no, x.subject_name, x.source, x.first_seen) for x in docs.collect()) == [("R1-1", "a", "excel", at), ("R1-2", "d", "excel", at)]
    assert tuple(r.ingest_metrics(batch, docs).first()) == (0, 3, 3)
    live = r.merge_batch(docs, batch.filter("k = 2"), [F.col("k")], live=True)
    assert {x.iis_no: (x.subject_name, x.source, x.last_verified) for x in live.collect()} == {"R1-1": ("a", "excel", None), "R1-2": ("c", "iis_live", at)}


def test_mode_that_is_reached_first(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("abba")] + [(2, 0, None)], "g int, k int, v string")
    assert sorted((x.g, x.v) for x in r.first_reached_mode(rows, ["g"], "v", ["k"]).collect()) == [(1, "b"), (2, None)]


def sealed(spark, pages):
    df = spark.createDataFrame(pages, "doc_id int, position int, no string, k int, n int, kid string, body string, bare boolean, shown string")
    s = seals.seal(KEYS, F.col("kid"), F.col("no"), F.col("k"), F.col("n"), seals.page_digest(F.col("body")))
    line = F.when(F.col("bare"), "").otherwise(t.seal_line(F.col("no"), F.col("k"), F.col("n"), F.col("kid"), F.coalesce(s, F.lit("AAAA-AAAA"))))
    return df.select("doc_id", "position", F.concat_ws("\n", "shown", line).alias("text"))


def test_documents(spark):
    page = lambda doc, pos, k=None, shown=None, bare=False, no="R1-2026-000001", kid="1": (doc, pos, no, k or pos, 3, kid, f"Page {k or pos}", bare, shown or f"Page {k or pos}")
    pages = [page(1, p) for p in (1, 2, 3)] + [page(2, 1), page(2, 2, shown="Page two"), page(2, 3)] + [page(3, 1), page(3, 2, bare=True, k=9), page(3, 3)] + [page(4, 1, 2), page(4, 2, 1), page(4, 3), page(4, 4, 3)] + [page(5, 1, kid="7"), page(5, 2, no="R1-2026-000009"), page(5, 3)]
    findings, docs = i.document_findings(i.page_status(sealed(spark, pages), KEYS))
    assert {x.doc_id: x.status for x in docs.collect()} == {1: "intact", 2: "tampered", 3: "tampered", 4: "tampered", 5: "tampered"}
    said = {}
    for x in sorted(findings.collect(), key=lambda x: (x.doc_id, x.phase, x.position, x.rule)):
        said.setdefault(x.doc_id, []).append(x.finding)
    assert said[2] == ["Page 2 (page 2) content was altered."]
    assert said[3] == ["Page at position 2 carries no seal (inserted or unsealed).", "Page 2 of 3 is missing."]
    assert said[4] == ["Page 1 is out of order (claims to be page 2).", "Page 2 is out of order (claims to be page 1).", "Page 4 is out of order (claims to be page 3).", "Page 3 is duplicated.", "Document should have 3 pages but has 4."]
    assert said[5] == ["Page 1 (page 1) content was altered.", "Page 2 belongs to a different document (R1-2026-000009)."]


def test_documents_against_an_expected_number(spark):
    rows = [(1, 1, "R1-2026-000001", 1, 2, "verified"), (1, 2, "R1-2026-000001", 2, 2, "verified"), (2, 1, "R1-2026-000002", 1, 1, "verified"), (3, 1, None, None, None, "not_sealed")]
    pages = spark.createDataFrame([(a, b, c, k, n, "1", "s", st) for a, b, c, k, n, st in rows], "doc_id int, position int, iis_no string, claimed_k int, claimed_n int, kid string, seal string, status string")
    docs = i.document_findings(pages, spark.createDataFrame([(1, "R1-2026-000009"), (2, ""), (3, "R1-2026-000003"), (4, "x")], "doc_id int, expected_no string"))[1]
    assert sorted((x.doc_id, x.iis_no, x.claimed_pages, x.n_findings, x.status) for x in docs.collect()) == [(1, "R1-2026-000009", None, 2, "tampered"), (2, "R1-2026-000002", 1, 0, "intact"), (3, "R1-2026-000003", None, 1, "tampered")]


def test_resolution_by_code(spark):
    docs = spark.createDataFrame([(k,) for k in range(1, 7)], "doc_id int")
    codes = [(1, 2, 1, "https://r.example/b"), (1, 1, 2, "https://r.example/a"), (2, 1, 1, "https://r.example@evil.example/"), (3, 1, 1, "https://r.example/c"), (4, 1, 1, "https://R.example/d"), (5, 1, 1, None)]
    pages = [("https://r.example/a", "IIS No: R1-2026-000001\nSubject: Ana"), ("https://r.example/a", None), ("https://R.example/d", "nothing"), ("https://r.example@evil.example/", "IIS No: R1-2026-000001")]
    got = r.qr_resolutions(docs, spark.createDataFrame(codes, "doc_id int, page_no int, seq int, url string"), spark.createDataFrame(pages, "url string, page_text string"), "https://r.example")
    assert sorted((x.doc_id, x.ok, x.reason, x.iis_no, x.page_no) for x in got.collect()) == [(1, True, None, "R1-2026-000001", 1), (2, False, "no-qr", None, None), (3, False, "unreachable", None, None), (4, False, "no-record", None, None), (5, False, "no-qr", None, None), (6, False, "no-qr", None, None)]


def test_page_verdicts(spark):
    s = one(spark, seals.seal(KEYS, F.lit("1"), F.lit("R1-2026-000001"), F.lit(1), F.lit(3), F.lit("d")))
    pages = spark.createDataFrame([("R1-2026-000001", 1, 3, "1", s, "d"), ("R1-2026-000002", 1, 3, "7", s, "d")], "iis_no string, page_no int, total_pages int, kid string, seal string, digest string")
    req = spark.createDataFrame([(1, "R1-2026-000001", 1, None, s), (2, "R1-2026-000001", 1, 3, "AAAA-AAAA"), (3, "R1-2026-000001", 1, 9, s), (4, "R1-2026-000009", 1, None, s), (5, None, 1, None, s), (6, "R1-2026-000002", 1, None, s)], "req_id int, iis_no string, k int, n int, seal string")
    assert {x.req_id: x.status for x in i.page_verdicts(req, pages, KEYS).collect()} == {1: "page_verified", 2: "invalid_seal", 3: "page_count_mismatch", 4: "not_sealed", 5: "invalid_code", 6: "unknown_key"}


def test_control_numbers(spark):
    pages = spark.createDataFrame([(1, 1, "see R1-2026-000002 and Control No.: R1-2026-000001."), (1, 2, "R1-2026-000002 xR1-2026-000003 R1-2026-0000044"), (1, 3, None)], "doc_id int, page_no int, text string")
    got = [(x.iis_no, x.pages, x.labelled, x["rank"]) for x in r.control_numbers(pages).orderBy("rank").collect()]
    assert got == [("R1-2026-000001", [1], True, 1), ("R1-2026-000002", [1, 2], False, 2)]


def test_every_query_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 3
    sql = e.oracle_sql()
    for name, q in e.queries().items():
        df = q(spark, SF)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()
    assert set(sql) <= set(e.queries())
