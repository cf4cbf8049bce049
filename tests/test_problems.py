"""Problems 1, 3 and 4 on small fixtures, against brute force, and at their edges."""

import datetime as dt
import random

from pyspark.sql import functions as F

from attesta.operators import orphans as o, profile as p, snapshots as s

LOG = "id bigint, ts timestamp, queried_id string, resolved_iis_no string, outcome string, path string, client_hint string"
PAGES = "iis_no string, page_no int, created_at timestamp, key string, bits bigint"
REG = "iis_no string, first_seen timestamp, since string, block int"
GONE = "iis_no string, removed_at timestamp"
T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def found(spark, log, pages, reg, gone):
    df = o.orphan_references(spark.createDataFrame(log, LOG), spark.createDataFrame(pages, PAGES), spark.createDataFrame(reg, REG), spark.createDataFrame(gone, GONE))
    return sorted((r.src_table, r.ref_month, r.ref_key, r.reason) for r in df.collect())


def test_orphans_of_each_kind_and_dirty_numbers(spark):
    log = [(1, T(5), None, " embr1-2024-0001/p3", "", "", None), (1, T(5), None, " embr1-2024-0001/p3", "", "", None), (2, T(0), None, "R1-2024-0001", "", "", None), (3, T(40), None, "R1-2024-0002", "", "", None), (4, T(1), None, "R1-2024-9999", "", "", None), (5, T(1), None, "  ", "", "", None), (6, T(1), None, None, "", "", None), (7, None, None, "R1-2024-0001", "", "", None), (8, T(1), None, "what", "", "", None)]
    pages = [("R1-2024-0003", 2, T(3), "x", 1), ("R1-2024-0001", 1, T(9), None, None), (None, 1, T(1), None, None)]
    reg = [("R1-2024-0001", T(2), "clash", 0), ("R1-2024-0001", T(8), None, 0), ("embR1-2024-0002", T(0), None, 0), (None, T(0), None, 0)]
    got = found(spark, log, pages, reg, [("R1-2024-0002 ", T(40)), ("R1-2024-0002", T(60))])
    assert got == [("pages", "2024-01", "R1-2024-0003/p2", "missing"), ("verify_log", "2024-01", "2", "early"), ("verify_log", "2024-01", "4", "missing"), ("verify_log", "2024-01", "8", "missing"), ("verify_log", "2024-02", "3", "removed")]


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], [], [], []) == []
    assert found(spark, [(1, T(0), None, "R1-2024-0001", "", "", None)], [], [], []) == [("verify_log", "2024-01", "1", "missing")]


def test_every_join_finds_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    key = lambda: f"R1-2024-{rnd.randrange(300):04d}"
    log = [(i, T(rnd.randrange(90)), None, "R1-2024-0007" if i % 3 == 0 else "R1-2024-9999" if i % 7 == 0 else key(), "", "", None) for i in range(900)]
    reg = [(key(), T(rnd.randrange(60)), None, 0) for _ in range(250)]
    gone = [(key(), T(rnd.randrange(90))) for _ in range(40)]
    first = {}
    for k, at, *_ in reg:
        first[k] = min(first.get(k, at), at)
    until = {}
    for k, at in gone:
        until[k] = min(until.get(k, at), at)
    want = sorted(("verify_log", f"{at:%Y-%m}", str(i), "missing" if k not in first else "early" if first[k] > at else "removed") for i, at, _, k, *_ in log if k not in first or first[k] > at or (k in until and until[k] <= at))
    assert found(spark, log, [], reg, gone) == want
    # Ten times as many keys a word as meant: more pass the filter, the rows are the same.
    for setting in ({"KEYS_PER_WORD": 70}, {"BROADCAST_ROWS": 0}, {"FILTER_BYTES": 0}, {"BROADCAST_ROWS": 0, "FILTER_BYTES": 0, "HOT_KEYS": 10}):
        with monkeypatch.context() as m:
            for name, value in setting.items():
                m.setattr(o, name, value)
            assert found(spark, log, [], reg, gone) == want
    reg_df = spark.createDataFrame(reg, REG)
    refs = o.registry_references(spark.createDataFrame(log, LOG), spark.createDataFrame([], PAGES))
    report = o.filter_report(o.judged(refs, o.registry_parents(reg_df, spark.createDataFrame(gone, GONE)))).collect()
    n_missing = sum(k not in first for _, _, _, k, *_ in log)
    assert [(r.n_references, r.n_missing) for r in report] == [(900, n_missing)] and 0.9 * n_missing <= report[0].n_proved <= n_missing


def test_the_hot_keys_are_found(spark):
    refs = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id) END AS key")
    assert o.hot_keys(refs) == ["hot"]
    assert o.hot_keys(refs.limit(0)) == []


def test_bloom_filter_never_misses_a_key(spark):
    keys = spark.range(15_000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = o.filter_segments(15_000)
    filt = o.bloom_filter(keys, "key", n)
    h = F.xxhash64("key")
    probe = lambda df: df.withColumn("segment", o._segment(o._word(h, n))).join(filt, "segment", "left").filter(o._passes(h, n)).count()
    assert probe(keys) == 15_000
    assert probe(spark.range(15_000, 45_000).select(F.concat(F.lit("k"), "id").alias("key"))) < 0.06 * 30_000
    assert [(r.segment, len(r.words)) for r in filt.orderBy("segment").collect()] == [(i, o.SEGMENT) for i in range(n)]


SNAP = "snapshot_no int, iis_no string, " + ", ".join(f"{c} string" for c in (*s.REGISTRY_FIELDS, *s.REGISTRY_TIMES)) + ", pair string"


def snap(no, key, seen="2024-01-01T00:00:00Z", verified=None, name="A"):
    return (no, key, name, None, None, None, None, None, "excel", seen, verified, "clash")


def changes(spark, rows):
    return sorted(tuple(r) for r in s.snapshot_changes(spark.createDataFrame(rows, SNAP)).collect())


def test_snapshot_changes(spark):
    rows = [
        snap(1, "R1-2024-0001"), snap(2, "r1-2024-0001 ", "2024-01-01T08:00:00+08:00", " ", " A "), snap(1, "R1-2024-0002"), snap(2, "R1-2024-0003"), snap(1, "R1-2024-0004"), snap(2, "R1-2024-0004", name="a"),
        snap(1, "R1-2024-0005"), snap(3, "R1-2024-0005"), snap(3, "R1-2024-0001", "2024-01-01 00:00:00"), snap(3, "R1-2024-0003", verified="2024-02-02T00:00:00Z"), snap(3, "R1-2024-0003", verified="2024-02-01T00:00:00Z", name="B"),
        snap(3, "R1-2024-0004", name="a"), snap(3, "R1-2024-0004", name="a"), snap(1, None), snap(2, "x"),
    ]
    want = [(2, "R1-2024-0002", "removed"), (2, "R1-2024-0003", "added"), (2, "R1-2024-0004", "changed"), (2, "R1-2024-0005", "removed"), (3, "R1-2024-0003", "changed"), (3, "R1-2024-0005", "added")]
    assert changes(spark, rows) == want


def test_snapshot_edges(spark):
    assert changes(spark, []) == []
    assert changes(spark, [snap(1, "R1-2024-0001")]) == []
    assert changes(spark, [snap(2, "R1-2024-0001", seen="soon"), snap(7, "R1-2024-0001", seen="soon ")]) == []
    assert changes(spark, [snap(2, "R1-2024-0001", seen="soon"), snap(7, "R1-2024-0002")]) == [(7, "R1-2024-0001", "removed"), (7, "R1-2024-0002", "added")]


TYPES = "type_no int, type_name string"
ROWS = "load_no int, row_no int, iis_no string, transaction_type string, emb_id string, attachment_ref string, field_name string, value string"


def test_profile_cases(spark):
    rows, n = [], 0
    for load in range(1, 6):
        for i in range(40):
            n += 1
            no = f"R1-2024-{n:06d}"
            kind = "VISIT" if load == 5 and i < 20 else ["VISIT", "PERMIT", "NOTE", "LETTER"][i % 4]
            emb = None if load == 4 and i < 15 else f"EMBR1-{n:07d}-{i % 100:02d}"
            rows.append([load, i + 2, f" {no} ", kind, emb, f"{no}/", "clash", None])
    rows[0][4] = "EMBR1-12-3"
    rows[1][5] = "R1-2024-000001/"
    rows[2][3] = "VISIT "
    rows[3][2] = None
    df, types = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(i, t) for i, t in enumerate(["VISIT", "PERMIT", "NOTE", "LETTER"])], TYPES)
    want = [(1, "attachment_ref", 3), (1, "attachment_ref", 5), (1, "emb_id", 2), (1, "transaction_type", 4), (4, "emb_id", 0), (5, "transaction_type", 0)]
    assert sorted(map(tuple, p.registry_cases(df, types).collect())) == want
    induced = p.registry_expressions(df, types)
    assert {c: [p.readable(a, ["iis_no"]) for a in e] for c, e in induced.items()} == {"transaction_type": ["{transaction_types}"], "emb_id": [r"EMBR1\-[0-9]{7}\-[0-9]{2}"], "attachment_ref": ["{iis_no}/"]}
    # The rows come from the expressions: without them every value breaks the form.
    assert sorted(map(tuple, p.registry_cases(df, types, {}).filter("row_no > 0").collect())) != [x for x in want if x[2]]
    without = p.induce_expressions(df, "load_no", ["emb_id", "attachment_ref", "transaction_type"])
    assert [a.text for a in without["attachment_ref"]] == [r"R1\-2024\-[0-9]{6}/"]


def test_an_expression_is_no_habit(spark):
    """Neither a habit of one load nor a mistake that every load repeats is part of the form; a second form that all loads share is."""
    rows = []
    for load in range(1, 8):
        for i in range(100):
            v = f"AB-{load * 1000 + i * 7:05d}"
            if load == 3 and i % 2:
                v = f"old/{i:03d}"
            elif i in (4, 5):
                v = v.lower()
            elif i % 5 == 0:
                v = f"X{i:02d}.{load}"
            rows.append((load, v, None if i else ""))
    e = p.induce_expressions(spark.createDataFrame(rows, "load int, a string, b string"), "load", ["a", "b"])
    assert [x.text for x in e["a"]] == [r"AB\-[0-9]{5}", r"X[0-9]{2}\.[0-9]"] and "b" not in e
    words = spark.createDataFrame([(i % 4, "".join(random.Random(i).choice("abcdefgh") for _ in range(3 + i % 9)) + f" {i}", None) for i in range(400)], "load int, a string, b string")
    assert [x.text for x in p.induce_expressions(words, "load", ["a"])["a"]][0] in (r"[a-z]+\s[0-9]+", r"[a-z]+\s[0-9]{3}", r"[a-z]+\ [0-9]+")


def test_profile_counts(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "bb", None), (1, " ", 5), (1, None, 7), (2, "a", 1)], "load int, v string, n int")
    got = sorted(map(tuple, p.profile(rows, "load", ["v", "n"]).collect()))
    assert got == [(1, "n", 4, 1, 1, 2, "5", "7", 1, 1), (1, "v", 4, 1, 2, 2, "a", "bb", 1, 2), (2, "n", 1, 0, 0, 1, "1", "1", 1, 1), (2, "v", 1, 0, 0, 1, "a", "a", 1, 1)]


def test_profile_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    types = spark.createDataFrame([(1, "A")], TYPES)
    assert p.registry_cases(empty, types).collect() == []
    assert p.profile(empty, "load_no", ["emb_id"]).collect() == []
    assert p.coverage(empty, "load_no", ["emb_id"], {}).collect() == []
    # Without enough values to learn from, an expression may not be found: then every value that isn't blank breaks it.
    odd = spark.createDataFrame([(1, 2, None, None, "", "  ", None, None), (1, 3, None, "é" * 5000, "\n", "\0", None, None), (None, None, None, None, None, None, None, None)], ROWS)
    assert {tuple(r)[1] for r in p.registry_cases(odd, types).filter("row_no > 0").collect()} <= {"attachment_ref", "emb_id", "transaction_type"}
