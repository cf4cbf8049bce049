"""Boxes on pages: what a seal would cover, and where there is room for it.

Lengths are points with the origin at the bottom left. Boxes come as rows (doc_id, page_no, kind, text, rule, x0, y0, x1,
y1); joins are equi-joins on the document with the overlap as a residual condition, so pages stay apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The seal's measures.
MARK_MM, MARGIN, BASELINE, LINE_SIZE, GAP, ADVANCE = 16, 26, 34, 6, 8, 0.6
TOUCH, RULE, WIDEN = 0.01, 2, 0.5
STEP, EDGE, QUIET = 6, 20, 12
SAMPLE_LINE = "EMB · R1-2026-000000 · p1/1 · K1 · AAAA-AAAA"


def seal_size(mm: float = MARK_MM) -> float:
    return mm / 25.4 * 72


def block_size(line: str = SAMPLE_LINE, mm: float = MARK_MM) -> tuple[float, float]:
    """Width and height of the mark with the printed line under it."""
    return max(seal_size(mm), len(line) * LINE_SIZE * ADVANCE), GAP + LINE_SIZE + seal_size(mm)


def seal_rect(page_width: Column, mm: float = MARK_MM) -> Column:
    """The mark in its usual corner."""
    s = seal_size(mm)
    return F.struct((page_width - MARGIN - s).alias("x0"), F.lit(float(BASELINE)).alias("y0"), (page_width - MARGIN).cast("double").alias("x1"), F.lit(BASELINE + s).alias("y1"))


def seal_block(page_width: Column, line: str = SAMPLE_LINE, mm: float = MARK_MM) -> Column:
    """The mark and the line as one block."""
    w, h = block_size(line, mm)
    y0 = float(BASELINE - GAP - LINE_SIZE)
    return F.struct((page_width - MARGIN - w).alias("x0"), F.lit(y0).alias("y0"), (page_width - MARGIN).cast("double").alias("x1"), F.lit(y0 + h).alias("y1"))


def overlap(a: str, b: str) -> Column:
    """Do two boxes share an area? Touching edges don't count."""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (c(a, "x0") < c(b, "x1") - TOUCH) & (c(a, "x1") > c(b, "x0") + TOUCH) & (c(a, "y0") < c(b, "y1") - TOUCH) & (c(a, "y1") > c(b, "y0") + TOUCH)


def text_boxes(items: DataFrame) -> DataFrame:
    """The boxes of text items (str, x, y, width, height); blank items drop out."""
    rest = [c for c in items.columns if c not in ("str", "x", "y", "width", "height")]
    x, y, h = F.col("x"), F.col("y"), F.coalesce("height", F.lit(0.0))
    return items.filter(F.trim(F.coalesce("str", F.lit(""))) != "").select(*rest, F.lit("text").alias("kind"), F.trim("str").alias("text"), F.lit(False).alias("rule"), x.alias("x0"), (y - 0.25 * h).alias("y0"), (x + F.coalesce("width", F.lit(0.0))).alias("x1"), (y + 0.85 * h).alias("y1"))


_D, _START = T.DoubleType(), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_DRAWN = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("rule", T.BooleanType()), *[T.StructField(c, _D) for c in ("x0", "y0", "x1", "y1")]]))


def _moved(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def boxes_of(ops) -> list[dict]:
    """The boxes of one page's operators, in order: the current matrix is carried along, saved and restored."""
    m, stack, out = _START, [], []
    for r in ops:
        op, a = r["op"], [float(v) for v in (r["args"] if r["args"] is not None else [])]
        if op == "save":
            stack.append(m)
        elif op == "restore":
            m = stack.pop() if stack else _START
        elif op == "transform":
            ends = [_moved(m, a[0] + a[4], a[1] + a[5]), _moved(m, a[2] + a[4], a[3] + a[5]), _moved(m, a[4], a[5])]
            (ux, uy), (vx, vy), (ox, oy) = ends
            m = (ux - ox, uy - oy, vx - ox, vy - oy, ox, oy)
        elif op in ("image", "path"):
            corners = [(0, 0), (1, 0), (0, 1), (1, 1)] if op == "image" else [(a[0], a[1]), (a[2], a[3])]
            xs, ys = zip(*(_moved(m, *c) for c in corners))
            x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            thin = min(x1 - x0, y1 - y0) < RULE
            if op == "path":
                x1, y1 = (x0 + WIDEN if x1 == x0 else x1), (y0 + WIDEN if y1 == y0 else y1)
            out.append({"seq": int(r["seq"]), "kind": "image" if op == "image" else "graphic", "rule": op == "path" and thin, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
    return out


@F.pandas_udf(_DRAWN)
def drawn_udf(ops: pd.Series) -> pd.Series:
    return pd.Series([boxes_of(page) for page in ops])


def drawn_boxes(ops: DataFrame) -> DataFrame:
    """The boxes of drawing operators (doc_id, page_no, seq, op, args ARRAY<DOUBLE>).

    op: 'save', 'restore', 'transform' (six numbers), 'image', 'path' (x0, y0, x1, y1) or 'clip' (a path that isn't painted).
    The operators of a page are one array, which the page bounds. Lines without thickness are widened; what is thinner than
    RULE is a rule.
    """
    pages = ops.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "op", "args"))).alias("ops"))
    return pages.select("doc_id", "page_no", F.explode(drawn_udf("ops")).alias("b")).select("doc_id", "page_no", "b.*")


def seal_hits(boxes: DataFrame, pages: DataFrame, line: str = SAMPLE_LINE) -> DataFrame:
    """The boxes that the seal in its usual corner would touch. pages: (doc_id, page_no, page_w, page_h)."""
    seal = pages.select("doc_id", "page_no", seal_block(F.col("page_w"), line).alias("s")).select("doc_id", "page_no", "s.*")
    same = (F.col("b.doc_id") == F.col("s.doc_id")) & (F.col("b.page_no") == F.col("s.page_no"))
    return boxes.alias("b").join(seal.alias("s"), same & overlap("b", "s")).select("b.*")


def seal_fit(boxes: DataFrame, pages: DataFrame, line: str = SAMPLE_LINE) -> DataFrame:
    """Per page what the seal would cover: clear, covered (texts, the first of equals, in reading order of seq), images, shapes, rules."""
    hits = seal_hits(boxes, pages, line)
    drawn = lambda rule: (F.col("kind") == "graphic") & (F.col("rule") == F.lit(rule))
    per = hits.groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct(F.col("seq").cast("bigint").alias("seq"), "text")))).alias("_t"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(drawn(False)).alias("shapes"), F.count_if(drawn(True)).alias("rules")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    covered = F.array_distinct(F.transform(F.coalesce("_t", F.array().cast("array<struct<seq:bigint,text:string>>")), lambda x: x["text"]))
    j = pages.select("doc_id", "page_no").join(per, ["doc_id", "page_no"], "left").withColumn("covered", covered)
    return j.select("doc_id", "page_no", ((F.size("covered") == 0) & (zero("images") == 0) & (zero("shapes") == 0)).alias("clear"), "covered", zero("images").alias("images"), zero("shapes").alias("shapes"), zero("rules").alias("rules"))


def document_fit(fit: DataFrame) -> DataFrame:
    """Per document: clear on every page, and the clear pages that a rule crosses."""
    ruled = F.array_sort(F.collect_list(F.when(F.col("clear") & (F.col("rules") > 0), F.col("page_no"))))
    return fit.groupBy("doc_id").agg(F.bool_and("clear").alias("clear"), ruled.alias("ruled"))


def blocked_text(fit: DataFrame) -> DataFrame:
    """What stands in the way on each page that isn't clear, in words."""
    counted = lambda n, one: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s")))
    parts = F.concat_ws(", ", F.when(F.size("covered") > 0, F.concat(F.lit("text “"), F.array_join("covered", " "), F.lit("”"))), counted(F.col("images"), "image"), counted(F.col("shapes"), "drawn shape"))
    return fit.filter(~F.col("clear")).select("doc_id", "page_no", F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), parts).alias("detail"))


def grid_spots(pages: DataFrame, line: str = SAMPLE_LINE) -> DataFrame:
    """(doc_id, x0, y0, hx, hy): the places for the block on a grid over a document's first page, with its usual corner."""
    w, h = block_size(line)
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct("page_w", "page_h"), "page_no").alias("p")).select("doc_id", "p.*")
    axis = lambda room, need: F.when(room - EDGE - need >= EDGE, F.sequence(F.lit(0), F.floor((room - 2 * EDGE - need) / STEP).cast("int")))
    spots = first.withColumn("_y", F.explode(axis(F.col("page_h"), h))).withColumn("_x", F.explode(axis(F.col("page_w"), w)))
    return spots.select("doc_id", (F.lit(EDGE) + F.col("_x") * STEP).cast("double").alias("x0"), (F.lit(EDGE) + F.col("_y") * STEP).cast("double").alias("y0"), (F.col("page_w") - MARGIN - w).alias("hx"), F.lit(float(BASELINE - GAP - LINE_SIZE)).alias("hy"))


def free_spots(boxes: DataFrame, spots: DataFrame, line: str = SAMPLE_LINE) -> DataFrame:
    """The places where no box of any page of the document, rules aside, overlaps the mark with its quiet zone or the line.

    An anti join on the document with the overlaps as residual condition: each place meets the boxes of its own document only.
    """
    w, size = block_size(line)[0], seal_size()
    blocking = boxes.filter((F.col("kind") != "graphic") | ~F.col("rule")).select("doc_id", "x0", "y0", "x1", "y1")
    s, b = F.col, lambda n: F.col(f"b.{n}")
    mark_x, mark_y = s("s.x0") + (w - size), s("s.y0") + (GAP + LINE_SIZE)
    hits = lambda x0, y0, x1, y1: (b("x0") < x1 - TOUCH) & (b("x1") > x0 + TOUCH) & (b("y0") < y1 - TOUCH) & (b("y1") > y0 + TOUCH)
    room = hits(mark_x - QUIET, mark_y - QUIET, mark_x + size + QUIET, mark_y + size + QUIET)
    under = hits(s("s.x0"), s("s.y0"), s("s.x0") + w, s("s.y0") + LINE_SIZE)
    return spots.alias("s").join(blocking.alias("b"), (s("s.doc_id") == b("doc_id")) & (room | under), "left_anti")


def clear_spots(boxes: DataFrame, pages: DataFrame, line: str = SAMPLE_LINE) -> DataFrame:
    """Per document the free place nearest to the block's usual corner: (doc_id, found, x0, y0, moved_by, tried).

    Of equals the first from the bottom, then from the left.
    """
    spots = grid_spots(pages, line)
    d = F.hypot(F.col("x0") - F.col("hx"), F.col("y0") - F.col("hy"))
    best = free_spots(boxes, spots, line).groupBy("doc_id").agg(F.min(F.struct(d.alias("d"), "y0", "x0")).alias("m"))
    tried = spots.groupBy("doc_id").agg(F.count("*").alias("tried"))
    return pages.select("doc_id").distinct().join(tried, "doc_id", "left").join(best, "doc_id", "left").select("doc_id", F.col("m").isNotNull().alias("found"), "m.x0", "m.y0", F.floor(F.col("m.d") + 0.5).cast("int").alias("moved_by"), F.coalesce("tried", F.lit(0)).alias("tried"))


def cover_crop(frame_w: Column, frame_h: Column, box_w: Column, box_h: Column) -> Column:
    """The part of a camera frame that a box of other proportions shows; the whole frame while the box has no size."""
    wide = frame_w * box_h > frame_h * box_w
    none = ~(F.coalesce(box_w, F.lit(0)) > 0) | ~(F.coalesce(box_h, F.lit(0)) > 0)
    sw = F.when(none | ~wide, frame_w.cast("double")).otherwise(frame_h * box_w / F.nullif(box_h, F.lit(0)))
    sh = F.when(none | wide, frame_h.cast("double")).otherwise(frame_w * box_h / F.nullif(box_w, F.lit(0)))
    return F.struct(((frame_w - sw) / 2).alias("sx"), ((frame_h - sh) / 2).alias("sy"), sw.alias("sw"), sh.alias("sh"))
