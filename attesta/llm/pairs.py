"""Pairs of records out of links between classes of equal records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.sources.durable import durable, sized

#: Members of a class that one task pairs; larger classes are split over several.
CLASS_PART = 2000
BROADCAST_ROWS = 1_000_000


def record_pairs(members: DataFrame, links: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right): pairs of different keys, smaller first, whose forms are equal or linked. Each once.

    members: (key, form), a table just written; links: (a, b) between different forms. The members of a class of more than
    CLASS_PART are dealt out to parts on the left side, each of which meets the whole right side: no pair is lost, and no
    task holds a class by itself.
    """
    sizes = members.groupBy("form").agg(F.count("*").alias("n"))
    large = durable(sizes.filter(F.col("n") > CLASS_PART).select("form", F.ceil(F.col("n") / CLASS_PART).cast("int").alias("parts")))
    large = sized(large, BROADCAST_ROWS)
    parted = members.join(large, "form", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = parted.select(F.col("form").alias("a"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("_x"))
    several = sizes.filter("n > 1").select(F.col("form").alias("a"), F.col("form").alias("b"))
    ab = links.select("a", "b").unionByName(several).join(large.withColumnRenamed("form", "a"), "a", "left")
    ab = ab.select("a", "b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    x = ab.join(dealt, ["a", "part"]).join(members.select(F.col("form").alias("b"), F.col("key").alias("_y")), "b")
    x = x.filter((F.col("_x") < F.col("_y")) | ((F.col("_x") > F.col("_y")) & (F.col("a") != F.col("b"))))
    return x.select(F.least("_x", "_y").alias(left), F.greatest("_x", "_y").alias(right)).distinct()


def classes(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class_id, n_members, n_links): the class of equal forms of each record, its size, and the number of other classes that it is linked to."""
    sizes = members.groupBy("form").agg(F.count("*").alias("n_members"))
    ends = links.select(F.col("a").alias("form")).unionByName(links.select(F.col("b").alias("form"))).groupBy("form").agg(F.count("*").alias("n_links"))
    each = sizes.join(ends, "form", "left")
    return members.join(each, "form").select(F.col("key").alias(key), F.col("form").alias("class_id"), "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
