"""Golden cases of words, boxes, image quality, streams and spreadsheets."""

import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from attesta.operators import ocr, quality as q, spatial as s
from attesta.plans.stream_ops import sheet_bytes
from attesta.sources.sheet import registry_sheet
from attesta.streaming import requests as r


def word(text, x0, y0, conf=0.9, h=10):
    return {"seq": 0, "text": text, "confidence": conf, "x0": float(x0), "y0": float(y0), "x1": x0 + 30.0, "y1": float(y0 + h)}


def test_lines_follow_the_running_mean():
    words = [word("b", 40, 1), word("a", 0, 0), word("d", 40, 30), word("c", 0, 28), word("  ", 0, 60)]
    assert [[w["text"] for w in line] for line in ocr.cluster_lines(words)] == [["a", "b"], ["c", "d"]]
    assert ocr.cluster_lines([]) == ocr.cluster_lines([word("x", 0, 0, h=0)]) == []


def test_footer_goes_only_from_the_bottom_and_only_once():
    words = [word("Body", 0, 0), word("R1-2026-000123", 0, 100), word("copy", 40, 100)]
    assert ocr.without_footer("Body\nR1-2026-000123  copy\nR1-2026-000123 copy", words) == "Body\n\nR1-2026-000123 copy"
    paid = [word("Body", 0, 0), word("R1-2026-000123", 0, 100), word("₱500.00", 40, 100)]
    assert ocr.without_footer("R1-2026-000123 ₱500.00", paid) == "R1-2026-000123 ₱500.00"
    assert ocr.without_footer(None, []) == ""


def test_regions_take_each_word_once():
    words = [word("Pay", 0, 0), word("₱5,000.00", 40, 0, 0.5), word("₱5,000.00", 80, 0, 0.8), word("P5OOO.00", 120, 0)]
    f = lambda found, cls="money": {"found": found, "cls": cls}
    got = ocr.locate([f("₱5,000.00"), f("₱5,000.00"), f("₱5,000.00"), f(None), f("pay ₱5,000.00", "name")], words)
    assert [g and (g["x0"], g["confidence"]) for g in got] == [(40, 0.5), (80, 0.8), None, None, None]


def test_faint_tolerant_findings_drop(spark):
    kind = "array<struct<severity:string,region:struct<confidence:double>>>"
    df = spark.createDataFrame([([("tolerant", (0.3,)), ("tolerant", (0.4,)), ("tolerant", None), ("material", (0.1,))],)], f"f {kind}")
    assert len(df.select(ocr.drop_faint(F.col("f")).alias("f")).first().f) == 3


def test_drawing_operators():
    op = lambda seq, op, *args: {"seq": seq, "op": op, "args": list(args)}
    got = s.boxes_of([op(1, "save"), op(2, "transform", 2, 0, 0, 3, 10, 20), op(3, "image"), op(4, "path", 0, 0, 5, 0), op(5, "restore"), op(6, "clip", 0, 0, 9, 9), op(7, "path", 1, 1, 4, 9), op(8, "restore")])
    assert [(g["seq"], g["kind"], g["rule"], g["x0"], g["y0"], g["x1"], g["y1"]) for g in got] == [(3, "image", False, 10, 20, 12, 23), (4, "graphic", True, 10, 20, 20, 20.5), (7, "graphic", False, 1, 1, 4, 9)]


def test_clear_spot_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(d, rnd.randint(1, 2), "graphic" if i % 4 == 0 else "text", i % 4 == 0, float(x := rnd.randrange(560)), float(y := rnd.randrange(800)), x + 60.0, y + 25.0) for d in (1, 2) for i in range(30)]
    boxes = spark.createDataFrame(rows, "doc_id int, page_no int, kind string, rule boolean, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(d, p, 595.0, 842.0) for d in (1, 2, 3) for p in (1, 2)] + [(4, 1, 100.0, 100.0)], "doc_id int, page_no int, page_w double, page_h double")
    w, h = s.block_size()
    size, meet = s.seal_size(), lambda b, x0, y0, x1, y1: b[4] < x1 - 0.01 and b[6] > x0 + 0.01 and b[5] < y1 - 0.01 and b[7] > y0 + 0.01
    want = {}
    for d in (1, 2, 3):
        best, y = None, 20
        while y + h <= 822:
            x = 20
            while x + w <= 575:
                mine = [b for b in rows if b[0] == d and not b[3]]
                mx, my = x + w - size, y + 14
                if not any(meet(b, mx - 12, my - 12, mx + size + 12, my + size + 12) or meet(b, x, y, x + w, y + 6) for b in mine):
                    dist = np.hypot(x - (595 - 26 - w), y - 20)
                    if best is None or dist < best[0] - 1e-9:
                        best = (dist, float(x), float(y))
                x += 6
            y += 6
        want[d] = best and best[1:]
    got = {x.doc_id: x for x in s.clear_spots(boxes, pages).collect()}
    assert {d: (got[d].x0, got[d].y0) if got[d].found else None for d in (1, 2, 3)} == want
    assert (got[4].found, got[4].tried) == (False, 0)


def test_blur_forms_agree(spark):
    g = np.random.default_rng(7).integers(0, 256, (9, 11), np.uint8)
    px = spark.createDataFrame([(1, x, y, int(g[y, x])) for y in range(9) for x in range(11)], "image_id int, x int, y int, v int")
    assert abs(q.pixel_blur(px).first().variance - q.laplacian_variance(g)) < 1e-6
    assert q.laplacian_variance(np.zeros((2, 9), np.uint8)) == 0


def test_paced_calls(spark):
    rows = [("a", i, t) for i, t in enumerate([0, 10, 20, 9000, 9001])] + [("b", 9, 5)]
    got = r.paced_batch(spark.createDataFrame(rows, "source string, req_id bigint, arrival_ms bigint"), 3000).orderBy("req_id").collect()
    assert [x.scheduled_ms for x in got] == [0, 3000, 6000, 9000, 12000, 5]


def test_paced_calls_beyond_32_bits(spark):
    """Calls times gap pass 2**31."""
    gap = 900_000_000
    got = r.paced_batch(spark.createDataFrame([("a", i, i) for i in range(5)], "source string, req_id bigint, arrival_ms bigint"), gap).orderBy("req_id").collect()
    assert [x.scheduled_ms for x in got] == [i * gap for i in range(5)]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet_bytes([("R1-2026-000001", "Ana", None, "x", "", "kind", "ref/"), (None,) * 7, ("R1-2026-000002", None, "c", None, None, None, None)]))
    got = [tuple(x) for x in registry_sheet(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [(2, "R1-2026-000001", "Ana", "", "x", "", "kind", "ref/"), (4, "R1-2026-000002", "", "c", "", "", "", "")]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}"><Relationship Id="r1" Type="t" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/_rels/s.xml.rels", f'<Relationships xmlns="{pack}"><Relationship Id="h1" Type="t" Target="https://x.example/R1" TargetMode="External"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>head</t></si><si><r><t>R1-</t></r><r><t>9</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="D2"><v>12.5</v></c><c r="G2" t="inlineStr"><is><t>open</t></is></c></row></sheetData><hyperlinks><hyperlink ref="G2" r:id="h1"/></hyperlinks></worksheet>')
    got = [tuple(x) for x in registry_sheet(spark, str(tmp_path / "b.xlsx")).collect()]
    assert got == [(2, "R1-9", "", "", "12.5", "", "", "https://x.example/R1")]


REQ = "req_id bigint, ts timestamp, payload string, path string, client_hint string"


def test_a_registry_stream_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    import datetime as dt

    from attesta.operators.registry import ATTRIBUTES

    monkeypatch.setattr(r.RegistryStream, "COMPACT", 2)
    at = lambda h: dt.datetime(2024, 1, 1, h)
    cols = ", ".join(f"{c} string" for c in ATTRIBUTES)
    none = spark.createDataFrame([], f"iis_no string, {cols}, source string, first_seen timestamp, last_verified timestamp")
    live = spark.createDataFrame([("R1-2024-000001", *"abcdef"), ("R1-2024-000002", *"ghijkl")], f"iis_no string, {cols}")
    folder = str(tmp_path)
    schema = spark.createDataFrame([], REQ).schema

    def run(n, rows):
        spark.createDataFrame(rows, REQ).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        sink = r.RegistryStream(none, live, f"{folder}/out")
        r.run_available(stream, sink, f"{folder}/checkpoint")
        return sink

    run(1, [(1, at(1), "R1-2024-000001", "staff", None), (2, at(2), "R1-2024-000009", "staff", None)])
    run(2, [(3, at(3), "R1-2024-000001", "public", None), (4, at(4), "R1-2024-000002", "public", None)])
    run(3, [(5, at(5), "R1-2024-000002", "staff", None), (6, at(6), "R1-2024-000002", "public", None)])
    sink = run(4, [(7, at(7), "R1-2024-000002", "public", None), (8, at(8), None, "public", None)])
    got = {x.req_id: x.status for x in sink.log().collect()}
    assert got == {1: "verified_live", 2: "not_found", 3: "verified_local", 4: "needs_staff", 5: "verified_live", 6: "verified_local", 7: "verified_local", 8: "invalid"}
    docs = {x.iis_no: (x.subject_name, x.source, x.first_seen, x.last_verified) for x in sink.documents().collect()}
    assert docs == {"R1-2024-000001": ("a", "iis_live", at(1), at(1)), "R1-2024-000002": ("g", "iis_live", at(5), at(5))}
    # A batch that is repeated sees what it saw, not what it wrote.
    sink(spark.createDataFrame([(5, at(5), "R1-2024-000002", "staff", None), (6, at(6), "R1-2024-000002", "public", None)], REQ), 2)
    assert {x.req_id: x.status for x in sink.log().collect()} == got and sink.documents().count() == 2
