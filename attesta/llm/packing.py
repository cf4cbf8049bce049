"""Filling fixed-capacity containers (problem 7) by sum-of-squares online packing.

N(h) is the number of containers that are filled to level h; each item goes to the level, or to a new container, after
which the sum of N(h)**2 over the partly filled levels is least. The levels are one array, the containers of a level a
stack. The order of items is that of a hash of their id, so that it is no order of size or time.

Items are packed in shards of about SHARD_ITEMS; a shard gets ids and sizes only. What its containers leave open is packed
once more over GROUP shards together, so that the loss at the ends of shards is shared. An item larger than the capacity,
and no other, is split: into full containers and a rest that is packed like an item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from attesta.sources.durable import durable

SHARD_ITEMS = 20_000
GROUP = 16
#: Containers that are filled less than this go into the second round.
FULL_ENOUGH = 0.98


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item in order; sizes from 0 to capacity. Items of size 0 need no room and lie in the first container."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[0] and count[capacity] stay 0: neither is partly filled
    stacks: dict[int, list[int]] = {}
    used, out = 0, np.zeros(len(sizes), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        best, level = (0 if s == capacity else 2 * int(count[s]) + 1), 0
        if s < capacity:
            here = count[1 : capacity - s + 1]
            delta = np.where(here > 0, 2 * (count[s + 1 : capacity + 1] - here) + 2, never)
            if here[-1] > 0:
                delta[-1] -= 1  # a container that becomes full leaves the sum
            k = len(delta) - 1 - int(delta[::-1].argmin())  # of equals the fullest
            if delta[k] <= best and here[k] > 0:
                level = k + 1
        if level:
            bin_no = stacks[level].pop()
            count[level] -= 1
        else:
            bin_no = used
            used += 1
        filled = level + s
        if filled < capacity:
            count[filled] += 1
            stacks.setdefault(filled, []).append(bin_no)
        out[i] = bin_no
    return out


def pieces(sizes: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, piece_no, tok_from, tok_to, size): one piece an item, more only of an item larger than the capacity."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity)).cast("int"))
    cut = sizes.select(id_col, n.alias("_n"), F.explode(F.sequence(F.lit(1), count)).alias("piece_no"))
    start = (F.col("piece_no") - 1) * F.lit(capacity)
    return cut.select(id_col, "piece_no", start.cast("int").alias("tok_from"), F.least(F.col("_n"), start + F.lit(capacity)).cast("int").alias("tok_to")).withColumn("size", F.col("tok_to") - F.col("tok_from"))


def pack(sizes: DataFrame, capacity: int, n_items: int, id_col: str = "doc_id") -> DataFrame:
    """(container, id_col, piece_no, tok_from, tok_to): the content of every container.

    sizes: (id_col, n_tokens), ids unique; n_items: about how many. Null sizes count as 0. Empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    kind = sizes.schema[id_col].dataType.simpleString()
    schema = f"container string, {id_col} {kind}, piece_no int, tok_from int, tok_to int, size int, place bigint, again boolean"
    shards = max(1, -(-n_items // SHARD_ITEMS))
    groups = max(1, -(-shards // GROUP))

    def packed(prefix: str, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["order", id_col, "piece_no"], kind="stable").reset_index(drop=True)
            place = int(pdf["place"].iat[0])
            bins = sum_of_squares(pdf["size"].to_numpy(np.int64), capacity)
            filled = np.bincount(bins, weights=pdf["size"].to_numpy(np.float64))
            again = np.zeros(len(pdf), bool) if last else (filled < FULL_ENOUGH * capacity)[bins]
            out = pdf[[id_col, "piece_no", "tok_from", "tok_to", "size"]].copy()
            out.insert(0, "container", [f"{prefix}{place}-{b}" for b in bins])
            return out.assign(place=place, again=again)

        return run

    order = F.xxhash64(F.col(id_col))
    first = pieces(sizes, capacity, id_col).withColumn("order", order).withColumn("place", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(shards)))
    one = first.groupBy("place").applyInPandas(packed("a", shards == 1), schema)
    if shards == 1:
        return one.select("container", id_col, "piece_no", "tok_from", "tok_to")
    one = durable(one)
    open_ = one.filter("again").drop("container", "again").withColumn("order", order).withColumn("place", F.pmod(F.col("place"), F.lit(groups)))
    two = open_.groupBy("place").applyInPandas(packed("b", True), schema)
    return one.filter("NOT again").unionByName(two).select("container", id_col, "piece_no", "tok_from", "tok_to")


def split_items(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The items that lie in more than one piece."""
    return packed.filter(F.col("piece_no") == 2).select(id_col)
