"""The queries of the problems over text (2, 5, 6, 7 and 8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import addresses, bpe, language, names, packing
from attesta.sources.durable import durable
from attesta.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_address_records(table(spark, d, "registry"), table(spark, d, "barangays"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return addresses.address_classes(table(spark, d, "registry"), table(spark, d, "barangays"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_records(table(spark, d, "registry"), table(spark, d, "given_names"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(table(spark, d, "registry"), table(spark, d, "given_names"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), bpe.vocabulary_path(spark))


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    docs = table(spark, d, "documents")
    return bpe.count_tokens(docs, bpe.vocabulary_path(spark)), docs.count()


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "container_kinds").select("container_kind", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("container_kinds is no short list of kinds")
    return {r[0]: r[1] for r in rows}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sizes, n = _sizes(spark, d)
    crate = _capacities(spark, d).get("crate")
    return sizes.select("doc_id").limit(0) if crate is None else packing.split_items(packing.pack(sizes, crate, n))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes, n = _sizes(spark, d)
    sizes = durable(sizes)  # read for every kind of container
    return reduce(DataFrame.unionByName, [packing.pack(sizes, c, n).withColumn("container_kind", F.lit(k)) for k, c in sorted(_capacities(spark, d).items())])


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"), table(spark, d, "language_names"), table(spark, d, "review_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_cases(p8_segments(spark, d))


def p8_confidence(spark: SparkSession, d: str) -> DataFrame:
    return language.confidence_report(p8_segments(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p5_found, p5_classes, p6_ids, p7_found, p7_containers, p8_found, p8_segments, p8_confidence)}
SQL: dict[str, str] = {}
