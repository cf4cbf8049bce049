"""Queries of the symbol operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attesta.operators import symbol as s
from attesta.sources.durable import durable
from attesta.sources.spread import spread
from attesta.sources.tables import table


#: What a payload has to look like.
_FIT = r"^CVR\|R1-(20|21)[0-9]{2}-[0-9]{6}\|[0-9]{1,3}\|[A-Z2-7]{4}-[A-Z2-7]{4}$"
#: Pixels of a side of the square pictures, two a tile.
SIDE = 2 * s.N


def payloads(spark, d):
    """A payload for each page on file; every seventh has a number that can't be carried."""
    r = table(spark, d, "pages").select(F.regexp_extract(F.upper("iis_no"), "R1-[0-9]{4}-[0-9]{4,}", 0).alias("no"), "page_no", "seal").filter("no <> ''").distinct()
    return spread(r.select(F.concat_ws("|", F.lit("CVR"), F.when(F.col("page_no") == 7, F.lit("R1-1999-12")).otherwise(F.col("no")), F.col("page_no").cast("string"), "seal").alias("payload")).distinct())


def ref_k6_pack(spark, d):
    """The eleven data bytes as they lead the code word."""
    c = payloads(spark, d).withColumn("code", s.encode_udf("payload"))
    return c.filter("code IS NOT NULL").select("payload", F.lower(F.substring(F.hex("code"), 1, 22)).alias("data"))


def ref_k9_rs_encode(spark, d):
    c = payloads(spark, d).withColumn("code", s.encode_udf("payload"))
    return c.select("payload", F.hex("code").alias("code"), F.length("code").alias("bytes"))


def ref_k10_rs_decode(spark, d):
    """Round trip with up to twelve bytes overwritten."""
    c = payloads(spark, d).withColumn("code", s.encode_udf("payload")).filter("code IS NOT NULL")
    n = F.pmod(F.xxhash64("payload"), F.lit(13)).cast("int")
    worn = F.unhex(F.concat(F.repeat(F.lit("A5"), n), F.substring(F.hex("code"), 2 * n + 1, F.lit(70))))
    return c.withColumn("read", s.decode_udf(worn)).select("payload", "read", (F.col("read") == F.col("payload")).alias("same"))


def ref_k11_tiles(spark, d):
    t = payloads(spark, d).withColumn("tiles", s.tiles_udf()("payload")).filter("tiles IS NOT NULL")
    return t.select("payload", F.length(F.replace("tiles", F.lit("0"), F.lit(""))).alias("inked"), (s.read_tiles_udf()("tiles") == F.col("payload")).alias("same"))


def ref_s11_svg(spark, d):
    v = payloads(spark, d).withColumn("svg", s.svg_udf()("payload")).filter("svg IS NOT NULL")
    return v.select("payload", F.md5("svg").alias("md5"), F.size(F.split("svg", "<rect ")).alias("rects"))


def _worn(a: np.ndarray, k: int) -> bytes:
    """A picture as it comes from paper: as it is, blurred, with a pen stroke over it, or unevenly lit."""
    side, a = len(a), a.astype(np.float32)
    if k == 1:
        a = (a + np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1)) / 5
    elif k == 2:
        a[side * 5 // 11 : side * 5 // 11 + 2] = 40
    elif k == 3:
        a = a * (0.75 + 0.25 * np.linspace(0, 1, side, dtype=np.float32))[None, :]
    return a.astype(np.uint8).tobytes()


#: Pictures of a task, and of a batch: a picture is 64 KB.
TASK, BATCH = 1000, 100
_PICTURE = "image_id string, width int, height int, gray binary"


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worn pictures (image_id, width, height, gray) of (payload, how)."""
    art = s.artwork(s.disc())
    for b in batches:
        for some in (b.slice(k, BATCH) for k in range(0, b.num_rows, BATCH)):
            ids, gray, sides = some.column(0).to_pylist(), [], []
            for payload, how in zip(ids, some.column(1).to_pylist()):
                tiles = s.tiles_for(payload, art)
                img = None if tiles is None else s.rasterize(tiles, 220)
                gray.append(None if img is None else _worn(img, how))
                sides.append(None if img is None else len(img))
            side = pa.array(sides, pa.int32())
            yield pa.RecordBatch.from_arrays([some.column(0), side, side, pa.array(gray, pa.binary())], ["image_id", "width", "height", "gray"])


def fit_payloads(spark, d):
    """The payloads that can be carried, as a table just written."""
    return durable(payloads(spark, d).filter(F.col("payload").rlike(_FIT)))


def tasks_for(rows: int, spark) -> int:
    """Tasks for so many pictures: TASK each, so that none holds many at a time, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))


def pictures(payloads_, tasks):
    """A worn picture (image_id, width, height, gray) of the symbol of each payload, a batch or a stream; only payloads are moved, never pictures."""
    return payloads_.select("payload", (F.crc32("payload") % 4).cast("int").alias("how")).repartition(tasks).mapInArrow(_drawn, _PICTURE)


def ref_k12_decode(spark, d):
    p = fit_payloads(spark, d)
    return s.decode_images(pictures(p, tasks_for(p.count(), spark)), deal=False).withColumn("same", F.col("payload") == F.col("image_id"))


def squares(spark, d):
    """A square picture of SIDE pixels for each supplier, two pixels a tile: rings whose width depends on the number, some of one tone."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    i, x, y = F.col("image_id"), F.col("x"), F.col("y")
    ring = F.floor(((x - 44) * (x - 44) + (y - 40) * (y - 40)) / (i % 7 * 40 + 60)).cast("int")
    return p.withColumn("v", F.when(i % 9 == 0, 20 + x % 3).when(ring % 3 == 1, 250 - y % 4).otherwise(30 + (x * 7 + y * 13) % 190).cast("int"))


def ref_k13_baseline(spark, d):
    return s.baseline(squares(spark, d), SIDE).withColumnRenamed("c", "col")


def ref_k14_fixed_groups(spark, d):
    return s.fixed_groups(s.baseline(squares(spark, d), SIDE)).withColumnRenamed("c", "col")


def ref_a15_recovery(spark, d):
    """4,000 words for each number of parity bytes and rate of flipped bits."""
    return s.recovery(spark, 4000, [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10], [12, 24])


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("ref_") and callable(f)}

_SQUARES = f"SELECT image_id, x, y, CASE WHEN image_id % 9 = 0 THEN 20 + x % 3 WHEN CAST(floor(((x - 44) * (x - 44) + (y - 40) * (y - 40)) / (image_id % 7 * 40 + 60)) AS INTEGER) % 3 = 1 THEN 250 - y % 4 ELSE 30 + (x * 7 + y * 13) % 190 END AS v FROM (SELECT s_suppkey AS image_id, unnest(range(0, {SIDE})) AS x FROM supplier), (SELECT unnest(range(0, {SIDE})) AS y)"
_PAY = "SELECT DISTINCT concat_ws('|', 'CVR', CASE WHEN page_no = 7 THEN 'R1-1999-12' ELSE no END, page_no, seal) AS payload FROM (SELECT DISTINCT regexp_extract(upper(iis_no), 'R1-[0-9]{4}-[0-9]{4,}', 0) AS no, page_no, seal FROM pages) WHERE no <> ''"
_SEALBITS = "list_sum(list_transform(range(0, 8), lambda i: CAST(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(s, i + 1, 1)) - 1 AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(35 - 5 * i AS INTEGER))))"
_TILES = f"SELECT image_id, CAST(y // 2 AS INTEGER) AS r, CAST(x // 2 AS INTEGER) AS col, avg(CAST(v < 200 AS INTEGER)) > 0.5 AS ink FROM ({_SQUARES}) GROUP BY 1, 2, 3"
_BASE = f"""SELECT *, ink AND coalesce(lag(ink) OVER a, false) AND coalesce(lead(ink) OVER a, false) AND coalesce(lag(ink) OVER b, false) AND coalesce(lead(ink) OVER b, false) AS carrier FROM ({_TILES})
  WINDOW a AS (PARTITION BY image_id, r ORDER BY col), b AS (PARTITION BY image_id, col ORDER BY r)"""

SQL = {
    "ref_k12_decode": f"SELECT payload AS image_id, payload, true AS same FROM ({_PAY}) WHERE regexp_matches(payload, '{_FIT}')",
    "ref_k6_pack": f"""SELECT payload, printf('1f%02x%06x%02x%010x', CAST(substr(payload, 8, 4) AS INTEGER) - 2000, CAST(substr(payload, 13, 6) AS INTEGER), CAST(split_part(payload, '|', 3) AS INTEGER), CAST({_SEALBITS} AS BIGINT)) AS data
      FROM (SELECT payload, replace(split_part(payload, '|', 4), '-', '') AS s FROM ({_PAY}) WHERE regexp_matches(payload, '{_FIT}'))""",
    "ref_k10_rs_decode": f"SELECT payload, payload AS read, true AS same FROM ({_PAY}) WHERE regexp_matches(payload, '{_FIT}')",
    "ref_k13_baseline": f"SELECT * FROM ({_BASE})",
    "ref_k14_fixed_groups": f"""SELECT image_id, r, col, CASE WHEN ink THEN 'on' WHEN bool_or(ink) OVER a AND bool_or(ink) OVER b AND bool_or(ink) OVER c AND bool_or(ink) OVER e THEN 'hole' ELSE 'field' END AS part FROM ({_BASE})
      WINDOW a AS (PARTITION BY image_id, r ORDER BY col), b AS (PARTITION BY image_id, r ORDER BY col DESC), c AS (PARTITION BY image_id, col ORDER BY r), e AS (PARTITION BY image_id, col ORDER BY r DESC)
      QUALIFY NOT carrier""",
}
