"""Spelling of words by a symmetric-delete index: two words within one edit or swap share a word that one deletion makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.sources.durable import durable, sized

#: A word is a slip of another that is so many times as common.
RATIO = 10
#: Words of more letters are indexed by their ends instead of their deletions, which would be as many as letters.
LONG = 24
#: The index of the words that slips may stand for is broadcast up to so many rows (some 60 bytes each).
BROADCAST_ROWS = 1_000_000


def deletes(w: Column) -> Column:
    """The word and every word that one deletion makes of it."""
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def _ends(w: Column) -> Column:
    """One edit or swap leaves the first or the last third of a word as it is; with the thirds of the lengths one less and one more."""
    n = F.length(w)
    thirds = F.array_distinct(F.array((n / 3).cast("int"), ((n - 1) / 3).cast("int"), ((n + 1) / 3).cast("int")))
    return F.flatten(F.transform(thirds, lambda k: F.array(F.concat(F.lit("<"), F.substring(w, F.lit(1), k)), F.concat(F.lit(">"), F.substring(w, n - k + 1, k)))))


def neighbour_keys(w: Column) -> Column:
    """Hashes of which two words within one edit or swap share at least one, whatever their length."""
    short, long = F.when(F.length(w) <= LONG + 1, deletes(w)).otherwise(F.array().cast("array<string>")), F.when(F.length(w) >= LONG, _ends(w)).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(short, long), lambda d: F.xxhash64(d))


def one_apart(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    edits = F.levenshtein(a, b)
    return (edits == 1) | ((edits == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), swapped))


def spellings(words: DataFrame, known: DataFrame, ratio: float = RATIO, shortest: int = 4) -> DataFrame:
    """(w, good) for words that are slips: `good` is within one edit or swap, and `ratio` times as common.

    A word in `known` need not be so common where the slip itself is in fewer than `ratio` forms, and in no more than the
    known word (or in a single one): so few say nothing of a word of its own.

    words: (w, n) distinct words with the number of forms that have them; known: (w), right as they are. Words of fewer
    than `shortest` letters have no slips. Only words that are known or in `ratio` forms can be meant: their index is small
    beside the text, and the others are looked up in it.
    """
    vocab = words.join(known.withColumn("is_known", F.lit(True)), "w", "full_outer").select("w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_known", F.lit(False)).alias("is_known")).filter(F.length("w") >= shortest)
    vocab = durable(vocab)
    good = durable(vocab.filter((F.col("n") >= ratio) | F.col("is_known")).select(F.explode(neighbour_keys(F.col("w"))).alias("d"), F.col("w").alias("good"), F.col("n").alias("ng"), "is_known"))
    slip = vocab.filter("NOT is_known AND n > 0").select(F.col("w"), F.col("n").alias("nw"), F.explode(neighbour_keys(F.col("w"))).alias("d"))
    near = slip.join(sized(good, BROADCAST_ROWS), "d").filter((F.col("w") != F.col("good")) & ((F.col("ng") >= ratio * F.col("nw")) | (F.col("is_known") & (F.col("nw") < ratio) & (F.col("nw") <= F.greatest("ng", F.lit(1))))))
    near = near.filter(one_apart(F.col("w"), F.col("good"))).withColumn("edits", F.levenshtein("w", "good"))
    return near.groupBy("w").agg(F.min_by("good", F.struct(~F.col("is_known"), F.col("edits"), -F.col("ng"), F.col("good"))).alias("good"))
