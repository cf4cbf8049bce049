"""What changed between full snapshots (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from attesta.functions.keys import canonical_no, instant_text

REGISTRY_FIELDS = ("subject_name", "company_name", "address", "emb_id", "transaction_type", "attachment_ref", "source")
#: Snapshots of a table at most; their numbers are in the plan.
MOST_SNAPSHOTS = 1000
#: Times are kept within so many microseconds of 1970, 36,000 years.
LATEST = 1 << 60
REGISTRY_TIMES = ("first_seen", "last_verified")

def snapshot_changes(snapshots: DataFrame, fields: Sequence[str] = REGISTRY_FIELDS, times: Sequence[str] = REGISTRY_TIMES, key: str = "iis_no", number: str = "snapshot_no", latest: str = "last_verified") -> DataFrame:
    """snapshot_no, iis_no, change_kind ('added', 'removed', 'changed') for each snapshot after the first.

    Each row counts on two sides: as the new side of its own snapshot and as the old side of the next one. Both sides of
    all pairs go through one aggregation by (pair, key), which keeps the row hash of the latest row of each side; partial
    aggregation before the shuffle takes a key that holds many rows down to one row a task. Blank fields are equal, spaces
    at the ends don't matter, times are compared as instants (text without an offset is UTC; text that is no time is
    compared as text). Rows without a document number belong to no record. Of rows of the same last_verified the one of the
    larger hash counts. Empty input and a single snapshot give no rows; further columns are ignored.
    """
    found = snapshots.select(number).distinct().limit(MOST_SNAPSHOTS + 1).collect()
    if len(found) > MOST_SNAPSHOTS:
        raise ValueError(f"{number} has more than {MOST_SNAPSHOTS} values")
    two_64 = F.lit(str(1 << 64)).cast("decimal(20,0)")
    numbers = sorted(r[0] for r in found if r[0] is not None)
    following = {a: b for a, b in zip(numbers, numbers[1:])}
    empty = F.lit("")
    hashed = F.xxhash64(*[F.coalesce(F.trim(F.col(c)), empty) for c in fields], *[instant_text(F.col(c)) for c in times])
    at = F.coalesce(instant_text(F.col(latest)).try_cast("bigint"), F.lit(-LATEST))
    # Time and hash in one number, so that the maximum is a fixed-width aggregate: no task sorts its rows.
    whole = F.greatest(F.lit(-LATEST), F.least(F.lit(LATEST), at)).cast("decimal(20,0)") * two_64 + hashed.cast("decimal(20,0)")
    nxt = F.lit(None).cast("int")
    for a, b in following.items():
        nxt = F.when(F.col(number) == a, F.lit(b)).otherwise(nxt)
    row = snapshots.select(F.col(number).cast("int").alias("no"), nxt.alias("nxt"), canonical_no(F.col(key)).alias("key"), whole.cast("decimal(38,0)").alias("v")).filter(F.col("key").isNotNull() & F.col("no").isNotNull())
    sides = row.select(F.explode(F.array(F.struct(F.col("no").alias("pair"), F.lit(True).alias("new")), F.struct(F.col("nxt").alias("pair"), F.lit(False).alias("new")))).alias("s"), "key", "v").select("s.*", "key", "v")
    sides = sides.filter(F.col("pair").isNotNull() & (F.col("pair") != F.lit(numbers[0] if numbers else 0)))
    both = sides.groupBy("pair", "key").agg(F.max(F.when(F.col("new"), F.col("v"))).alias("n"), F.max(F.when(~F.col("new"), F.col("v"))).alias("o"))
    hash_of = lambda v: F.pmod(v, two_64)
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(hash_of(F.col("n")) != hash_of(F.col("o")), "changed")
    return both.select(F.col("pair").alias("snapshot_no"), F.col("key").alias("iis_no"), kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes of each kind per snapshot."""
    return changes.groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_records"))
