"""Quality of captured images, over arrays of grey values or over a table of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Fixed values.
BLURRY, DARK, BRIGHT, CLIPPED, LOW, HIGH = 50, 60, 235, 0.5, 10, 245


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian inside the image; 0 without an inside."""
    g = gray.astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
    return float(lap.var())


@F.pandas_udf(T.DoubleType())
def blur_udf(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([laplacian_variance(np.frombuffer(g, np.uint8)[: w * h].reshape(h, w)) if g is not None and w and h else 0.0 for g, w, h in zip(gray, width, height)])


def pixel_blur(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """A9 in Catalyst, over pixels (image, x, y, v): neighbours by windows along rows and columns."""
    row, col = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    v = F.col("v").cast("double")
    lap = 4 * v - F.lag(v).over(row) - F.lead(v).over(row) - F.lag(v).over(col) - F.lead(v).over(col)
    return pixels.select(image, lap.alias("lap")).groupBy(image).agg(F.coalesce(F.var_pop("lap"), F.lit(0.0)).alias("variance"))


def exposure(mean: Column, n: Column, dark: Column, bright: Column) -> Column:
    """'dark', 'bright' or null from the mean and the counts of clipped pixels; null without pixels."""
    return F.when(n == 0, None).when((mean < DARK) | (dark / n > CLIPPED), "dark").when((mean > BRIGHT) | (bright / n > CLIPPED), "bright")


def pixel_exposure(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    v = F.col("v")
    a = pixels.groupBy(image).agg(F.avg(v).alias("mean"), F.count(v).alias("n"), F.count_if(v < LOW).alias("dark"), F.count_if(v > HIGH).alias("bright"))
    return a.select(image, F.coalesce(exposure(F.col("mean"), F.col("n"), F.col("dark"), F.col("bright")), F.lit("none")).alias("exposure"))


def capture_quality(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, blurry, exposure)."""
    return pixel_blur(pixels, image).join(pixel_exposure(pixels, image), image).select(image, (F.col("variance") < BLURRY).alias("blurry"), "exposure")


def otsu(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """A10: the threshold that parts each image's grey values best, the first of equals: a histogram and running sums over at most 256 values."""
    h = pixels.groupBy(image, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(image).orderBy("v")
    whole = Window.partitionBy(image)
    c, s = F.sum("c").over(w), F.sum(F.col("c") * F.col("v")).over(w)
    n, total = F.sum("c").over(whole), F.sum(F.col("c") * F.col("v")).over(whole)
    r = h.select(image, "v", c.alias("wb"), s.alias("sb"), n.alias("n"), total.alias("t"))
    wf = F.col("n") - F.col("wb")
    between = F.when(wf > 0, F.round(F.col("wb").cast("double") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("t") - F.col("sb")) / F.nullif(wf, F.lit(0)), 2), 3)).otherwise(0.0)
    return r.groupBy(image).agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def local_levels(pixels: DataFrame, radius: int, bias: float, image: str = "image_id") -> DataFrame:
    """A11 in Catalyst: for each pixel the mean of the box around it, cut at the edges, less `bias`: running sums along rows, then columns."""
    row = Window.partitionBy(image, "y").orderBy("x").rangeBetween(-radius, radius)
    col = Window.partitionBy(image, "x").orderBy("y").rangeBetween(-radius, radius)
    r = pixels.withColumn("_s", F.sum("v").over(row)).withColumn("_n", F.count("v").over(row))
    return r.withColumn("level", F.sum("_s").over(col) / F.sum("_n").over(col) - bias).drop("_s", "_n")


def cropped(pixels: DataFrame, boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """The pixels inside the box (x0, y0, x1, y1, edges included) of each image, counted from its corner."""
    b = pixels.join(boxes, image).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return b.select(image, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v")
