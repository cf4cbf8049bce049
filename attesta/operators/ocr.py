"""Recognised words of a page image: lines, the footer among them, where a finding stands, and confidence.

Words come as rows (image_id, seq, text, confidence, x0, y0, x1, y1). Operators whose result depends on what came before
within an image (running means, consumed words) take the words of one image as one array, which a page bounds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attesta.functions import text as t
from attesta.operators.tokens import LEAST_WORDS, _struct, canonical, compare_pages, extract_tokens

# Where a footer may stand, and the confidence that a reading needs.
FOOTER_BAND, FOOTER_LINES = 0.75, 8
LEAST_CONFIDENCE, LEAST_TOLERANT = 0.65, 0.4

_D = T.DoubleType()
_I = T.IntegerType()
WORD = _struct(seq=_I, text=T.StringType(), confidence=_D, x0=_D, y0=_D, x1=_D, y1=_D)


def flat_words(tree: Column) -> Column:
    """The words of blocks > paragraphs > lines > words, in order; missing levels are empty."""
    inner = lambda c, name: F.flatten(F.transform(c, lambda x: F.coalesce(x[name], F.array())))
    return inner(inner(inner(tree, "paragraphs"), "lines"), "words")


def word_arrays(words: DataFrame) -> DataFrame:
    """(image_id, words): the words of each image in their order."""
    return words.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WORD.fields]))).alias("words"))


def content_confidence(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(image_id, mean_confidence): mean over words with two letters or digits in a row; else the page's own confidence (0-100); else 0."""
    per = words.groupBy("image_id").agg(F.avg(F.when(t.text(F.col("text")).rlike("[a-zA-Z0-9]{2,}"), F.col("confidence"))).alias("c"))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("page_confidence") / 100))
    return pages.join(per, "image_id", "left").select("image_id", F.coalesce("c", F.when(~F.isnan("page_confidence"), own), F.lit(0.0)).alias("mean_confidence"))


def median_height(words: DataFrame) -> DataFrame:
    """(image_id, median_height): of n positive heights the one at place n // 2 of their order."""
    h = words.filter(F.trim("text") != "").select("image_id", (F.col("y1") - F.col("y0")).alias("h")).filter("h > 0")
    return h.groupBy("image_id").agg(F.array_sort(F.collect_list("h")).alias("hs")).select("image_id", F.element_at("hs", F.floor(F.size("hs") / 2).cast("int") + 1).alias("median_height"))


def union_boxes(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """The box around all boxes of a group."""
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def cluster_lines(words: Sequence[dict]) -> list[list[dict]]:
    """Words by line, top to bottom and left to right. A word joins the current line while its centre is within half the
    median height of the line's running mean."""
    usable = [w for w in words if w["text"] and w["text"].strip()]
    heights = sorted(h for w in usable if (h := w["y1"] - w["y0"]) > 0)
    if not heights:
        return []
    reach = heights[len(heights) // 2] / 2
    lines: list[list[dict]] = []
    mean = 0.0
    for w in sorted(usable, key=lambda w: (w["y0"] + w["y1"]) / 2):
        c = (w["y0"] + w["y1"]) / 2
        if lines and abs(c - mean) <= reach:
            lines[-1].append(w)
            mean += (c - mean) / len(lines[-1])
        else:
            lines.append([w])
            mean = c
    return [sorted(line, key=lambda w: w["x0"]) for line in lines]


def without_footer(text: str | None, words: Sequence[dict]) -> str:
    """The text without the footer line: of the last lines in the bottom band, from below, the first that holds a
    reference or citation and no amount, date or duration. Only its first occurrence goes."""
    text = text or ""
    lines = cluster_lines(words)
    if not lines:
        return text
    top = min(min(w["y0"], w["y1"]) for w in words)
    bottom = max(max(w["y0"], w["y1"]) for w in words)
    band = top + FOOTER_BAND * (bottom - top)
    for line in reversed(lines[-FOOTER_LINES:]):
        if sum((w["y0"] + w["y1"]) / 2 for w in line) / len(line) < band:
            continue
        found = {x.cls for x in extract_tokens(" ".join(w["text"] for w in line))}
        if found & {"reference", "citation"} and not found & {"money", "date", "duration"}:
            return re.sub(r"\s+".join(re.escape(w["text"]) for w in line), "", text, count=1)
    return text


def _lower(s: str | None) -> str:
    return canonical((s or "").lower())


def locate(findings: Sequence[dict], words: Sequence[dict]) -> list[dict | None]:
    """The region of each finding: the first run of free words that reads as it, in the order of findings, each word once;
    an amount may also be one word of the same digits. A region is the box around its words and their least confidence."""
    taken: set[int] = set()
    said = [_lower(w["text"]) for w in words]
    digits = [re.sub("[^0-9]", "", w["text"] or "") for w in words]

    def run(found: str) -> range | None:
        want = _lower(found).split(" ") if _lower(found) else []
        starts = (i for i in range(len(words) - len(want) + 1) if want and said[i : i + len(want)] == want and not taken & set(range(i, i + len(want))))
        return next((range(i, i + len(want)) for i in starts), None)

    out: list[dict | None] = []
    for f in findings:
        region = None
        if f["found"] is not None:
            at = run(f["found"])
            d = re.sub("[^0-9]", "", f["found"])
            if at is None and f["cls"] == "money" and d:
                at = next((range(i, i + 1) for i in range(len(words)) if i not in taken and digits[i] == d), None)
            if at is not None:
                taken |= set(at)
                ws = [words[i] for i in at]
                region = {"x0": min(w["x0"] for w in ws), "y0": min(w["y0"] for w in ws), "x1": max(w["x1"] for w in ws), "y1": max(w["y1"] for w in ws), "confidence": min(w["confidence"] for w in ws)}
        out.append(region)
    return out


_BOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D, confidence=_D)


@F.pandas_udf(T.ArrayType(T.ArrayType(_I)))
def lines_udf(words: pd.Series) -> pd.Series:
    return pd.Series([[[int(w["seq"]) for w in line] for line in cluster_lines(list(ws) if ws is not None else [])] for ws in words])


@F.pandas_udf(T.StringType())
def footer_udf(text: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([without_footer(s, list(ws) if ws is not None else []) for s, ws in zip(text, words)])


@F.pandas_udf(T.ArrayType(_BOX))
def locate_udf(findings: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([locate(list(f) if f is not None else [], list(ws) if ws is not None else []) for f, ws in zip(findings, words)])


def word_lines(words: DataFrame) -> DataFrame:
    """(image_id, line, place, seq) of every word that isn't blank."""
    made = word_arrays(words).select("image_id", F.posexplode(lines_udf("words")).alias("line", "seqs"))
    return made.select("image_id", (F.col("line") + 1).alias("line"), F.posexplode("seqs").alias("place", "seq")).withColumn("place", F.col("place") + 1)


def drop_faint(findings: Column) -> Column:
    """findings (with region) without the tolerant ones whose region was read with too little confidence."""
    return F.filter(findings, lambda f: (f["severity"] != "tolerant") | f["region"].isNull() | (f["region"]["confidence"] >= LEAST_TOLERANT))


def verify_page_images(requests: DataFrame, records: DataFrame, words: DataFrame) -> DataFrame:
    """The report on photographs of pages.

    requests: (image_id, iis_no, k, ocr_text, mean_confidence, word_count); records: (iis_no, k, auth_text) of the pages on
    file; words: the recognised words. status: no_record_copy, image_unreadable, page_differs or compared (F4).
    """
    r = requests.join(records, ["iis_no", "k"], "left")
    none = t.text(F.col("auth_text")) == ""
    faint = (F.col("mean_confidence") < LEAST_CONFIDENCE) | (F.col("word_count") < LEAST_WORDS)
    gate = F.when(none, "no_record_copy").when(faint, "image_unreadable")
    r = r.withColumn("gate", gate)
    empty = F.array().cast("array<struct<severity:string,cls:string,line:int,expected:string,found:string,reason:string,region:struct<x0:double,y0:double,x1:double,y1:double,confidence:double>>>")
    stopped = r.filter("gate IS NOT NULL").select("image_id", "iis_no", "k", F.col("gate").alias("status"), F.lit(0.0).alias("similarity"), empty.alias("findings"), F.lit(0).alias("suppressed"))
    on = r.filter("gate IS NULL").join(word_arrays(words), "image_id", "left")
    clean = on.select(F.col("image_id").alias("pair_id"), footer_udf("ocr_text", "words").alias("ocr_text"), "auth_text")
    done = compare_pages(clean).withColumnRenamed("pair_id", "image_id").join(on.select("image_id", "iis_no", "k", "words"), "image_id")
    located = done.withColumn("regions", locate_udf("findings", "words"))
    joined = F.zip_with("findings", "regions", lambda f, g: F.struct(f["severity"].alias("severity"), f["cls"].alias("cls"), f["line"].alias("line"), f["expected"].alias("expected"), f["found"].alias("found"), f["reason"].alias("reason"), g.alias("region")))
    return stopped.unionByName(located.select("image_id", "iis_no", "k", "status", "similarity", drop_faint(joined).alias("findings"), "suppressed"))


def calibration(reports: DataFrame) -> DataFrame:
    """Per label of the photographs the least and greatest similarity and the number of images with a material finding."""
    material = F.exists("findings", lambda f: f["severity"] == "material")
    return reports.groupBy("label").agg(F.count("*").alias("n_images"), F.min("similarity").alias("floor"), F.max("similarity").alias("ceiling"), F.count_if(material).alias("n_material"))
