"""Queries of the streaming operators and of the spreadsheet source, with their SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from attesta.plans import registry_ops as r, symbol_ops as y
from attesta.sources.durable import new_folder, write_file
from attesta.sources.sheet import registry_sheet
from attesta.sources.tables import table
from attesta.streaming import requests as s


def calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("source"), F.col("event_id").alias("req_id"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("arrival_ms")).distinct()


def ref_t1_paced(spark, d):
    return s.paced_batch(calls(spark, d), 60_000)


def _streamed(spark, rows, step):
    """`rows` as a stream of files through `step`, and what came out."""
    folder = new_folder(spark)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    out = step(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def ref_t1_paced_state(spark, d):
    """The same through the state of a stream."""
    return _streamed(spark, calls(spark, d), lambda x: s.paced(x, 60_000))


def ref_t4_cooldown(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("engine"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("at_ms"), F.col("event_id").alias("req_id"), (F.col("event_id") % 3 != 0).alias("ok"))
    return _streamed(spark, e, lambda x: s.cooled(x, 3_600_000))


def ref_t3_stream_log(spark, d):
    """The log of a stream over the requests: each batch sees what the batches before it found live."""
    folder = new_folder(spark)
    req = r._requests(spark, d).select("req_id", "ts", "payload", "path", "client_hint").orderBy("ts", "req_id")
    req.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    sink = s.RegistryStream(r._on_file(spark, d), _live_records(spark, d), f"{folder}/out")
    s.run_available(stream, sink, f"{folder}/checkpoint")
    return sink.log().select("req_id", "queried_id", "resolved_iis_no", "status", "outcome", "path", "client_hint")


def _live_records(spark, d):
    rows = r._loads(spark, d, True).withColumn("iis_no", r.canonical_no(F.col("iis_no"))).filter("iis_no IS NOT NULL")
    return rows.groupBy("iis_no").agg(*[F.max(c).alias(c) for c in r.r.ATTRIBUTES])


def ref_t5_frame_stream(spark, d):
    """Frames of a camera as a stream: worn pictures of the symbols of the pages on file, and what each shows. The frames are made in the stream."""
    p = y.fit_payloads(spark, d)
    tasks = y.tasks_for(p.count(), spark)
    return _streamed(spark, p, lambda x: s.frame_payloads(y.pictures(x, tasks)))


def sheet_bytes(rows: list[tuple]) -> bytes:
    """A small workbook with inline strings, as a fixture."""
    out = io.BytesIO()
    letters = "ABCDEFG"
    line = lambda n, cells: f'<row r="{n}">' + "".join(f'<c r="{letters[i]}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(cells) if v is not None) + "</row>"
    body = "".join(line(n, cells) for n, cells in enumerate([tuple(letters), *rows], 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def ref_s1_sheet(spark, d):
    """The transaction types written as a workbook and read back through the source."""
    rows = [(f"R1-2026-{r[0]:06d}", r[1], None, " x ", "", r[1].lower(), "a&b") for r in table(spark, d, "transaction_types").orderBy("type_no").collect()]  # a fixed list of a few types
    folder = new_folder(spark)
    write_file(spark, f"{folder}/a.xlsx", sheet_bytes(rows))
    return registry_sheet(spark, folder)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("ref_") and callable(f)}

_PACE = """WITH c AS (SELECT DISTINCT event_type AS source, event_id AS req_id, epoch_us(ts) // 1000 AS arrival_ms FROM events), i AS (SELECT *, 60000 * row_number() OVER (PARTITION BY source ORDER BY arrival_ms, req_id) AS i FROM c)
  SELECT source, req_id, arrival_ms, CAST(max(arrival_ms - i) OVER (PARTITION BY source ORDER BY arrival_ms, req_id ROWS UNBOUNDED PRECEDING) + i AS BIGINT) AS scheduled_ms FROM i"""

# Each start is the first attempt after the cool-down of the one before it, or follows a start that went well.
_COOL = """WITH RECURSIVE e AS (SELECT event_type AS engine, epoch_us(ts) // 1000 AS at_ms, event_id AS req_id, event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
  w AS (SELECT e.*, CASE WHEN ok THEN NULL ELSE at_ms END AS failed, CASE WHEN ok THEN 'started' ELSE 'failed' END AS outcome FROM e WHERE i = 1
    UNION ALL SELECT e.*, CASE WHEN w.failed IS NOT NULL AND e.at_ms - w.failed < 3600000 THEN w.failed WHEN e.ok THEN NULL ELSE e.at_ms END,
      CASE WHEN w.failed IS NOT NULL AND e.at_ms - w.failed < 3600000 THEN 'cooling' WHEN e.ok THEN 'started' ELSE 'failed' END FROM w JOIN e ON e.engine = w.engine AND e.i = w.i + 1)
  SELECT engine, at_ms, req_id, outcome FROM w"""

SQL = {
    "ref_t5_frame_stream": f"SELECT image_id, payload FROM ({y.SQL['ref_k12_decode']})",
    "ref_t4_cooldown": _COOL,
    "ref_t1_paced": _PACE,
    "ref_t1_paced_state": _PACE,
    "ref_t3_stream_log": r.SQL["ref_t2_backfill"],
    "ref_s1_sheet": "SELECT CAST(type_no + 1 AS INTEGER) AS row_no, printf('R1-2026-%06d', type_no) AS iis_no, type_name AS subject_name, '' AS company_name, ' x ' AS address, '' AS emb_id, lower(type_name) AS transaction_type, 'a&b' AS attachment_ref FROM transaction_types",
}
