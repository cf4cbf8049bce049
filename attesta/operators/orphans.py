"""References to records that do not exist (problem 1).

A Bloom filter over the parent keys proves definite orphans without a join; only the references that pass it are verified,
by an exact join. The filter is register-blocked: a key sets four bits of one 64-bit word, and the word's number and the
bits come from one hash. SEGMENT words make one row of the table (segment, words), an array that a probe reads at one place,
so the filter takes about a byte a key as a broadcast, too. It has KEYS_PER_WORD keys a word whatever the number of parents.

Up to FILTER_BYTES the filter is broadcast, beyond it is joined on the segment. Up to BROADCAST_ROWS the exact parents are
broadcast, beyond they are joined on the key. In both shuffle joins the hot keys, those with more than 1 / HOT_KEYS of the
references, leave beforehand: there are at most HOT_KEYS, so their parents are a small broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.keys import is_blank, key_of, utc_month
from attesta.sources.durable import durable

#: Words of a segment, a power of two.
SEGMENT_BITS = 10
SEGMENT = 1 << SEGMENT_BITS
#: 64 bits for 7 keys with four bits each: some 3 % of the missing keys pass.
KEYS_PER_WORD = 7
#: The filter is broadcast up to this size: 16 million words, 117 million parents.
FILTER_BYTES = 128 << 20
#: The exact parents, removals included, are broadcast up to so many keys (some 60 bytes each).
BROADCAST_ROWS = 400_000
HOT_KEYS = 200


def filter_segments(n_keys: int) -> int:
    return max(1, -(-n_keys // (KEYS_PER_WORD * SEGMENT)))


def _word(h: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(segments * SEGMENT))


def _segment(word: Column) -> Column:
    return F.shiftright(word, SEGMENT_BITS)


def _place(word: Column) -> Column:
    return word.bitwiseAND(F.lit(SEGMENT - 1)).cast("int")


def _bits(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    at = lambda s: F.call_function("shiftleft", one, F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int"))
    return at(0).bitwiseOR(at(6)).bitwiseOR(at(12)).bitwiseOR(at(18))


def bloom_filter(keys: DataFrame, key: str, segments: int) -> DataFrame:
    """(segment, words): the filter over `keys`, every word of every segment present."""
    h = F.xxhash64(F.col(key))
    words = segments * SEGMENT
    set_ = keys.filter(F.col(key).isNotNull()).select(_word(h, segments).alias("w"), _bits(h).alias("bits"))
    unset = keys.sparkSession.range(0, words, 1, max(1, words >> 20)).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits"))
    full = set_.unionByName(unset).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    pair = F.struct(_place(F.col("w")).alias("at"), "bits")
    packed = full.groupBy(_segment(F.col("w")).alias("segment")).agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return packed.select("segment", F.transform("x", lambda e: e["bits"]).alias("words"))


def _passes(h: Column, segments: int) -> Column:
    m = _bits(h)
    return F.coalesce(F.get("words", _place(_word(h, segments))).bitwiseAND(m) == m, F.lit(False))


def hot_keys(refs: DataFrame, key: str = "key") -> list:
    """The keys that may hold more than 1 / HOT_KEYS of the rows, by a frequency sketch in one pass; at most HOT_KEYS."""
    top = refs.agg(F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {HOT_KEYS}, {20 * HOT_KEYS})").alias("top")).head()
    return [e["item"] for e in top["top"] or [] if e["item"] is not None and e["count"] * HOT_KEYS > top["n"]]


def judged(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every row of `refs` (src_table, ref_key, key, at) with `proved` (the filter alone shows that the parent is missing) and `reason`.

    parents: (key, exists, since, until), any number of rows a key; the earliest `since` and the earliest `until` count.
    reason: 'missing' (no parent has the key), 'early' (since later than at), 'removed' (until at or before at), the first
    that holds; null where the record existed. A null `at` can only be 'missing'; a parent without `since` is never
    'early'. Null keys are no references. A key that only has an `until` and no row in the parent table is missing: such
    parents carry exists = false.
    """
    refs = refs.filter(F.col("key").isNotNull())
    known = durable(parents.groupBy("key").agg(F.bool_or("exists").alias("exists"), F.min("since").alias("since"), F.min("until").alias("until")))
    n_known = known.count()  # from the footers of the table just written
    segments = filter_segments(n_known)
    bloom = bloom_filter(known.filter("exists"), "key", segments)
    small_filter, small_parents = segments * SEGMENT * 8 <= FILTER_BYTES, n_known <= BROADCAST_ROWS
    hot = [] if small_filter and small_parents else hot_keys(refs)
    h = F.xxhash64("key")
    # A hot key needs no filter: it meets its parent in a broadcast of at most HOT_KEYS rows, and nothing elsewhere.
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    apart = F.pmod(F.xxhash64("ref_key", "at"), F.lit(1 << 20))
    own = _segment(_word(h, segments))
    probed = refs.withColumn("segment", own if small_filter else F.when(is_hot, -1 - apart).otherwise(own))
    probed = probed.join(F.broadcast(bloom) if small_filter else bloom, "segment", "left").withColumn("maybe", is_hot | _passes(h, segments)).drop("segment", "words")
    # A definite orphan meets no parent and comes out unmatched, in the same pass over the references.
    if small_parents:
        met = probed.withColumn("_k", F.when(F.col("maybe"), F.col("key"))).join(F.broadcast(known.withColumnRenamed("key", "_k")), "_k", "left")
    else:
        held = F.struct("exists", "since", "until")
        no_key = F.concat(F.lit("\0"), apart.cast("string"))
        met = probed.withColumn("_k", F.when(is_hot | ~F.col("maybe"), no_key).otherwise(F.col("key"))).join(known.select(F.col("key").alias("_k"), held.alias("cold")), "_k", "left")
        if hot:
            met = met.join(F.broadcast(known.filter(is_hot).select("key", held.alias("hot"))), "key", "left").withColumn("cold", F.coalesce("cold", "hot")).drop("hot")
        met = met.select("*", "cold.*").drop("cold")
    reason = F.when(~F.coalesce(F.col("exists"), F.lit(False)), "missing").when(F.col("since") > F.col("at"), "early").when(F.col("until") <= F.col("at"), "removed")
    return met.select("src_table", "ref_key", "key", "at", (~F.col("maybe")).alias("proved"), reason.alias("reason"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` whose record didn't exist at `at`, with `reason` and `proved`; see `judged`."""
    return judged(refs, parents).filter(F.col("reason").isNotNull())


def filter_report(judged_: DataFrame) -> DataFrame:
    """(src_table, n_references, n_missing, n_proved): how many of the missing references the filter alone proved."""
    return judged_.groupBy("src_table").agg(F.count("*").alias("n_references"), F.count_if(F.col("reason") == "missing").alias("n_missing"), F.count_if("proved").alias("n_proved"))


def registry_references(verify_log: DataFrame, pages: DataFrame) -> DataFrame:
    """The references of the log and of the pages as (src_table, ref_key, key, at)."""
    log = verify_log.filter(~is_blank(F.col("resolved_iis_no"))).select(
        F.lit("verify_log").alias("src_table"), F.col("id").cast("string").alias("ref_key"), key_of(F.col("resolved_iis_no")).alias("key"), F.col("ts").alias("at")
    )
    page = pages.filter(~is_blank(F.col("iis_no"))).withColumn("key", key_of(F.col("iis_no")))
    page = page.select(F.lit("pages").alias("src_table"), F.concat(F.col("key"), F.lit("/p"), F.coalesce(F.col("page_no").cast("string"), F.lit(""))).alias("ref_key"), "key", F.col("created_at").alias("at"))
    return log.unionByName(page)


def registry_parents(registry: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, exists, since, until) of registry rows and removals."""
    no_time = F.lit(None).cast("timestamp")
    rows = registry.select(key_of(F.col("iis_no")).alias("key"), F.lit(True).alias("exists"), F.col("first_seen").alias("since"), no_time.alias("until"))
    gone = removals.select(key_of(F.col("iis_no")).alias("key"), F.lit(False).alias("exists"), no_time.alias("since"), F.col("removed_at").alias("until"))
    return rows.unionByName(gone).filter(F.col("key").isNotNull())


def judged_references(verify_log: DataFrame, pages: DataFrame, registry: DataFrame, removals: DataFrame) -> DataFrame:
    """`judged` over the references and records of the registry."""
    return judged(registry_references(verify_log, pages), registry_parents(registry, removals))


def orphan_references(verify_log: DataFrame, pages: DataFrame, registry: DataFrame, removals: DataFrame) -> DataFrame:
    """One row for each orphan reference and month: src_table, ref_month, ref_key, reason.

    A reference delivered twice comes out once. Blank references are none; a reference that isn't blank but holds no
    document number is missing. Empty tables give their due: without a registry every reference is missing.
    """
    found = judged_references(verify_log, pages, registry, removals).filter(F.col("reason").isNotNull())
    return found.groupBy("src_table", utc_month(F.col("at")).alias("ref_month"), "ref_key").agg(F.min("reason").alias("reason"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return found.groupBy("src_table", "ref_month", "reason").agg(F.count("*").alias("n_references"))
