"""Same postal address written differently (problem 2), in SQL expressions, numbers first.

1. An address is cut into its numbers (house number, or lot and block; units, floors, rooms and stalls don't count) and its
   words. Words are brought to the spelling of the gazetteer, or of a word that is RATIO times as common, where a
   symmetric-delete index finds it within one edit. What names the street is never made a word of another part.
2. Runs of words are looked up in the gazetteer, the longest first: barangay, town, province; numbers as zip codes. A
   barangay of several towns is the one in the town that the address names; without one the place isn't known. What is left
   over are the kind of street and the words that name it.
3. Equal results are one *form*; only forms are compared. The block of a form is its sorted numbers, its town and its rarest
   word. A form with a word in fewer than RATIO addresses, which may be a slip that has no common spelling, seeks its
   partners by its other words too.
4. Two forms of a block are the same place when the rarity-weighted share of their common words is high, each word that is
   left over on one side has a counterpart within two edits on the other, and kind of street, barangay and town agree as
   far as both have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.keys import canonical_no
from attesta.llm.pairs import classes, record_pairs
from attesta.llm.spelling import RATIO, spellings
from attesta.sources.durable import durable, sized

# How the parts of an address are written.
KINDS = {
    "st": "street", "str": "street", "street": "street", "ave": "avenue", "av": "avenue", "avenue": "avenue", "blvd": "boulevard", "boul": "boulevard", "boulevard": "boulevard",
    "dr": "drive", "drv": "drive", "drive": "drive", "rd": "road", "road": "road", "ln": "lane", "lane": "lane", "subd": "subdivision", "subdiv": "subdivision", "subdivision": "subdivision",
}
NOISE = ("brgy", "bgy", "bo", "barangay", "city", "town", "municipality", "of", "no", "nr", "num", "number", "province", "the", "near", "philippines", "lot", "blk", "block")
UNIT = r"\b(unit|rm|room|stall|suite|door|apt)\b\.?\s*(no\b\.?)?\s*#?\s*([0-9]+(\s?-\s?[a-z]\b|[a-z]\b)?|[a-z]\b)|\b(ground|upper|lower|[0-9]+(st|nd|rd|th))\s+(floor|flr|fl)\b\.?|\b[0-9]+\s?/\s?f\b|\b(floor|flr)\s*[0-9]+\b"
LOT, BLOCK = r"\b(?:lot|l)\b?\.?\s*#?([0-9]+)\b", r"\b(?:block|blk|b)\b?\.?\s*#?([0-9]+)\b"
_WORD = r"((?<![\p{L}0-9])[0-9]+(?:st|nd|rd|th)(?![\p{L}0-9])|\p{L}+)"

#: Share of the weight of the words that the forms have in common; a word with a counterpart within EDITS counts half.
LEAST_OVERLAP = 0.55
EDITS = 2
#: Tables of words and places are broadcast up to so many rows (some 100 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 300_000


def parsed(addresses: DataFrame, text: str = "address") -> DataFrame:
    """`addresses` with lot_block ('l..b..', null without), digits (the other numbers) and words, in their order; no row for an address without a number."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"[\s ]+", " "), UNIT, " ")
    lot, block = F.regexp_extract("_t", LOT, 1), F.regexp_extract("_t", BLOCK, 1)
    both = (lot != "") & (block != "")
    rest = F.when(both, F.regexp_replace(F.regexp_replace("_t", LOT, " "), BLOCK, " ")).otherwise(F.col("_t"))
    digits = F.regexp_extract_all("_r", F.lit(r"(?<![a-z0-9])([0-9]+[a-z]?)(?![a-z0-9])"), 1)
    out = addresses.withColumn("_t", t).withColumn("lot_block", F.when(both, F.concat(F.lit("l"), lot, F.lit("b"), block))).withColumn("_r", rest)
    out = out.withColumn("digits", F.transform(digits, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""))).withColumn("words", F.regexp_extract_all("_r", F.lit(_WORD), 1))
    return out.drop("_t", "_r").filter(F.col("lot_block").isNotNull() | (F.size("digits") > 0))


def gazetteer(barangays: DataFrame) -> DataFrame:
    """(gram, role, barangay, town): each name of a place as its words, each zip, and the single words of provinces, which alone say nothing."""
    name = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(_WORD), 1), " ")
    b = barangays.select(name(F.col("barangay")).alias("b"), name(F.col("town")).alias("t"), name(F.col("province")).alias("p"), F.trim("zip").alias("z"))
    none = F.lit(None).cast("string")
    row = lambda gram, role, barangay, town: F.struct(gram.alias("gram"), F.lit(role).alias("role"), barangay.alias("barangay"), town.alias("town"))
    whole = F.array(row(F.col("b"), "b", F.col("b"), F.col("t")), row(F.col("t"), "t", none, F.col("t")), row(F.col("p"), "p", none, none), row(F.col("z"), "z", none, F.col("t")))
    words = F.transform(F.split("p", " "), lambda w: row(w, "p", none, none))
    return b.select(F.explode(F.concat(whole, words)).alias("x")).select("x.*").filter("gram <> ''").distinct()


def vocabulary(split: DataFrame, places: DataFrame) -> DataFrame:
    """(w, good, n, n_good, dropped, to_kind, spoken) for each word: its right spelling if it is a slip, how many addresses have a word of that spelling, and whether that is a word of a place, a kind or noise."""
    spoken = split.sparkSession.createDataFrame([(w,) for w in sorted({*KINDS, *NOISE})], "w string")
    place_words = places.filter("role <> 'z'").select(F.explode(F.split("gram", " ")).alias("w"))
    known = place_words.unionByName(spoken).distinct()
    counts = durable(split.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    fixes = durable(spellings(counts, known.filter(F.length("w") > 3)))
    meant = counts.join(fixes, "w", "left").withColumn("final", F.coalesce("good", "w"))
    of = meant.groupBy("final").agg(F.sum("n").alias("total"))
    out = meant.join(of, "final").join(of.select(F.col("final").alias("w"), F.col("total").alias("own")), "w", "left").join(known.select(F.col("w").alias("final"), F.lit(True).alias("is_known")), "final", "left")
    good = F.col("good")
    return out.select("w", "good", F.coalesce("own", "n").alias("n"), F.col("total").alias("n_good"), F.coalesce("is_known", F.lit(False)).alias("dropped"), F.coalesce(good.isin([*KINDS]), F.lit(False)).alias("to_kind"), F.coalesce(good.isin([*KINDS, *NOISE]), F.lit(False)).alias("spoken"))


def _kind_of(w: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[w]


def _spelled(split: DataFrame, words: DataFrame) -> DataFrame:
    """`split` with words as (pos, w, n), in their right spelling."""
    each = split.select("id", F.posexplode("words").alias("pos", "w")).join(words, "w", "left")
    each = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "good", "n", "n_good", "dropped", "to_kind", "spoken"))).alias("x"))
    kinds = [*KINDS]
    kinded = F.exists("x", lambda e: e["w"].isin(kinds))
    names = lambda e: F.coalesce(F.get("x", e["pos"] + 1)["w"].isin(kinds), F.lit(False))  # noqa: E731  the word before a kind names the street
    may = lambda e: e["good"].isNotNull() & ~(e["dropped"] & (names(e) | (e["to_kind"] & F.col("kinded"))))
    each = each.withColumn("kinded", kinded)
    each = each.withColumn("x", F.transform("x", lambda e: F.struct(e["pos"].alias("pos"), e["w"].alias("w"), F.when(may(e), e["good"]).alias("good"), e["n"].alias("n"), e["n_good"].alias("n_good"), e["dropped"].alias("dropped"), e["spoken"].alias("spoken"))))
    # Where no word would be left to name the street, what looks like a slip of a spoken word, or of one that is there too, is the name.
    left = F.exists("x", lambda e: ~F.when(e["good"].isNotNull(), e["dropped"]).otherwise(e["dropped"] & e["good"].isNull() & e["w"].isin([*KINDS, *NOISE])))
    named = F.exists("x", lambda e: ~e["dropped"] | (names(e) & e["good"].isNull()))
    written = F.transform("x", lambda e: e["w"])
    keeps = lambda e: ~(F.col("named") & F.col("left")) & (e["spoken"] | F.array_contains(F.col("written"), e["good"]))
    each = each.withColumn("written", written).withColumn("named", named).withColumn("left", left)
    final = F.transform("x", lambda e: F.when(e["good"].isNotNull() & ~keeps(e), F.struct(e["pos"].alias("pos"), e["good"].alias("w"), e["n_good"].alias("n"))).otherwise(F.struct(e["pos"].alias("pos"), e["w"].alias("w"), e["n"].alias("n"))))
    return split.drop("words").join(each.select("id", final.alias("words")), "id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<pos:int,w:string,n:bigint>>")))


def _placed(spelled: DataFrame, places: DataFrame, longest: int) -> DataFrame:
    """`spelled` with `found`: its runs of words and its numbers that the gazetteer has. A run before a kind of street names the street."""
    size = F.size("words")
    gram = lambda i, n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.transform(F.slice("words", i + 1, n), lambda e: e["w"]), " ").alias("gram"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: gram(i, n))).otherwise(F.array().cast("array<struct<at:int,n:int,gram:string>>"))))
    runs = F.filter(runs, lambda e: F.coalesce(~F.get("words", e["at"] + e["n"])["w"].isin([*KINDS]), F.lit(True)))
    zips = F.transform("digits", lambda d: F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), d.alias("gram")))
    each = spelled.select("id", F.explode(F.concat(runs, zips)).alias("e")).select("id", "e.*").join(places, "gram").filter((F.col("role") == "z") == (F.col("at") < 0))
    found = each.groupBy("id").agg(F.collect_list(F.struct("at", "n", "gram", "role", "barangay", "town")).alias("found"))
    out = spelled.join(found, "id", "left")
    return out.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))


def forms(records: DataFrame, barangays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, forms). members: (key, form), distinct. forms: (form, nums, kind, street, barangay, town); street is an array of (w, n).

    records: (key, address); rows with a null key or address, and addresses that name no single place, drop out.
    barangays: (barangay, town, province, zip).
    """
    places = durable(gazetteer(barangays))
    longest = places.filter("role <> 'z'").agg(F.max(F.size(F.split("gram", " ")))).head()[0] or 1
    texts = records.filter(F.col("key").isNotNull() & F.col("address").isNotNull()).select("key", "address")
    split = durable(parsed(texts.select("address").distinct()).withColumn("id", F.xxhash64("address")).drop("address"))
    words = sized(durable(vocabulary(split, places)), BROADCAST_ROWS)
    f = _placed(_spelled(split, words), sized(places, BROADCAST_ROWS), longest)

    # Of overlapping names the longest counts.
    inside = lambda m, o: (o["n"] > m["n"]) & (o["at"] <= m["at"]) & (m["at"] + m["n"] <= o["at"] + o["n"])
    f = f.withColumn("found", F.filter("found", lambda m: ~F.exists("found", lambda o: inside(m, o))))
    of = lambda role: F.filter("found", lambda m: m["role"] == role)
    first = lambda a: F.get(F.array_sort(F.array_distinct(a)), F.lit(0))
    f = f.withColumn("said", F.transform(of("t"), lambda m: m["town"])).withColumn("by_zip", F.transform(of("z"), lambda m: m["town"]))
    b = F.array_distinct(F.transform(of("b"), lambda m: F.struct(m["barangay"].alias("barangay"), m["town"].alias("town"))))
    f = f.withColumn("b", b)
    in_towns = lambda towns: F.filter("b", lambda m: F.array_contains(towns, m["town"]))
    f = f.withColumn("fit", F.when(F.size(in_towns(F.col("said"))) > 0, in_towns(F.col("said"))).when(F.size(in_towns(F.col("by_zip"))) > 0, in_towns(F.col("by_zip"))).otherwise(F.col("b")))
    # A barangay of several towns, none of which is named, is no known place.
    unclear = (F.size("fit") > 0) & (F.size(in_towns(F.concat("said", "by_zip"))) == 0) & F.exists("fit", lambda m: F.exists("fit", lambda o: (m["barangay"] == o["barangay"]) & (m["town"] != o["town"])))
    f = f.filter(~unclear).withColumn("barangay", first(F.col("fit"))["barangay"])
    f = f.withColumn("town", F.coalesce(first(F.col("fit"))["town"], first(F.col("said")), first(F.col("by_zip"))))

    placed = lambda i: F.exists("found", lambda m: (m["at"] >= 0) & (m["at"] <= i) & (i < m["at"] + m["n"]))
    before_kind = lambda e: F.coalesce(F.get("words", e["pos"] + 1)["w"].isin([*KINDS]), F.lit(False))
    f = f.withColumn("kind", first(F.filter(F.transform("words", lambda e: _kind_of(e["w"])), lambda k: k.isNotNull())))
    free = F.filter("words", lambda e: ~placed(e["pos"]) & ~e["w"].isin([*KINDS, *NOISE]) & ((F.length(e["w"]) > 2) | before_kind(e)))
    f = f.withColumn("street", F.array_sort(F.array_distinct(F.transform(free, lambda e: F.struct(e["w"].alias("w"), e["n"].alias("n"))))))
    zips = F.transform(of("z"), lambda m: m["gram"])
    f = f.withColumn("nums", F.coalesce("lot_block", F.nullif(F.array_join(F.array_sort(F.array_except("digits", zips)), ","), F.lit(""))))
    # Without a town in the gazetteer only what names a kind of street or a lot is an address.
    f = f.filter(F.col("nums").isNotNull() & (F.size("street") > 0) & (F.col("town").isNotNull() | F.col("kind").isNotNull()))
    or_none = lambda c: F.coalesce(c, F.lit("-"))
    form = F.xxhash64("nums", or_none("kind"), F.array_join(F.transform("street", lambda e: e["w"]), " "), or_none("barangay"), or_none("town")).alias("form")
    named = durable(f.select("id", form, "nums", "kind", "street", "barangay", "town"))
    members = texts.select("key", F.xxhash64("address").alias("id")).join(named.select("id", "form"), "id").select("key", "form").distinct()
    return members, durable(named.drop("id").distinct())


def weighed(forms_: DataFrame) -> DataFrame:
    """`forms_` with f, the form as a struct whose words carry the logarithm of their rarity."""
    total = F.lit(float(max(1, forms_.count())))
    words = F.transform("street", lambda e: F.struct(e["w"].alias("w"), F.log(1 + total / e["n"]).cast("float").alias("weight")))
    return forms_.withColumn("_s", words).withColumn("f", F.struct("form", "nums", "kind", "barangay", "town", F.col("_s").alias("street"))).drop("_s")


def same_places(forms_: DataFrame) -> DataFrame:
    """(a, b, ba, bb): pairs of different forms, a < b, that denote one place, and their barangays."""
    key = lambda w: F.xxhash64("nums", F.coalesce("town", F.lit("-")), w)
    f = weighed(forms_).withColumn("rare", F.array_min(F.transform("street", lambda e: F.struct((e["n"] < 2).alias("once"), e["n"].alias("n"), e["w"].alias("w"))))["w"])
    row = [F.col("f")]
    index = f.select(key(F.col("rare")).alias("block"), *row)
    a, b = index.select("block", F.col("f").alias("a")), index.select("block", F.col("f").alias("b"))
    met = a.join(b, "block").filter(F.col("a.form") < F.col("b.form"))
    # What may hold a slip without a common spelling seeks by each other word, among all words of all forms.
    words = lambda g: g.select(F.explode(F.transform("street", lambda e: e["w"])).alias("w"), "nums", "town", "rare", *row)
    unsure = f.filter((F.size("street") > 1) & F.exists("street", lambda e: e["n"] < RATIO))
    seek = durable(words(unsure).select(key(F.col("w")).alias("block"), F.col("f").alias("a")))
    sought = words(f).select(key(F.col("w")).alias("block"), F.col("f").alias("b")).join(sized(seek, BROADCAST_ROWS), "block").filter(F.col("a.form") != F.col("b.form"))
    met = met.select("a", "b").unionByName(sought.select("a", "b"))

    return same_place(durable(met.filter(compatible())))


def compatible() -> Column:
    """Numbers and town of forms a and b are the same; kind and barangay as far as both have them."""
    col = F.col
    agree = lambda c: col(f"a.{c}").isNull() | col(f"b.{c}").isNull() | (col(f"a.{c}") == col(f"b.{c}"))
    return (col("a.nums") == col("b.nums")) & col("a.town").eqNullSafe(col("b.town")) & agree("kind") & agree("barangay")


def same_place(met: DataFrame) -> DataFrame:
    """Of compatible candidates (a, b) those whose words are the same place, once each, as (a, b, ba, bb)."""
    col = F.col
    named = lambda s: F.transform(s, lambda e: e["w"])
    common = F.array_intersect(named(col("a.street")), named(col("b.street")))
    met = met.withColumn("common", common)
    rest = lambda s: F.filter(s, lambda e: ~F.array_contains(col("common"), e["w"]))
    met = met.withColumn("ra", rest(col("a.street"))).withColumn("rb", rest(col("b.street")))
    weight = lambda s: F.aggregate(s, F.lit(0.0), lambda x, e: x + e["weight"])
    near = lambda xs, ys: F.forall(xs, lambda x: F.exists(ys, lambda y: F.levenshtein(x["w"], y["w"]) <= EDITS))
    shared = weight(F.filter(col("a.street"), lambda e: F.array_contains(col("common"), e["w"])))
    left_over = F.greatest(weight(col("ra")), weight(col("rb")))  # each of these has to have a counterpart, and counts half
    met = met.filter(near(col("ra"), col("rb")) & near(col("rb"), col("ra")) & (shared + 0.5 * left_over >= LEAST_OVERLAP * (shared + left_over)))
    swap = col("a.form") > col("b.form")
    pick = lambda x, y, c: F.when(swap, col(f"{y}.{c}")).otherwise(col(f"{x}.{c}"))
    return met.select(pick("a", "b", "form").alias("a"), pick("b", "a", "form").alias("b"), pick("a", "b", "barangay").alias("ba"), pick("b", "a", "barangay").alias("bb")).distinct()


def settled(pairs: DataFrame) -> DataFrame:
    """Pairs without those between a form that names no barangay and forms of several barangays: its place isn't known."""
    both = pairs.select(F.explode(F.array(F.struct("a", "ba", "bb"), F.struct(F.col("b").alias("a"), F.col("bb").alias("ba"), F.col("ba").alias("bb")))).alias("x")).select("x.*")
    vague = both.filter("ba IS NULL AND bb IS NOT NULL").groupBy("a").agg(F.min("bb").alias("lo"), F.max("bb").alias("hi")).filter("lo <> hi").select(F.col("a").alias("v"))
    firm = (F.col("ba").isNull() != F.col("bb").isNull())
    odd = F.when(firm, F.when(F.col("ba").isNull(), F.col("a")).otherwise(F.col("b")))
    return pairs.withColumn("v", odd).join(vague, "v", "left_anti").select("a", "b")


def linked_forms(registry: DataFrame, barangays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of the registry: their forms, and the links between different forms."""
    records = registry.select(canonical_no(F.col("iis_no")).alias("key"), "address")
    members, forms_ = forms(records, barangays)
    return durable(members), durable(settled(durable(same_places(forms_))))


def same_address_records(registry: DataFrame, barangays: DataFrame) -> DataFrame:
    """(iis_a, iis_b): pairs of records with addresses of the same place, the smaller number first.

    Null, empty and vague addresses, and rows without a document number, make no pair; equally written addresses of a
    place do. Further columns and repeated rows don't matter; an empty table gives no rows.
    """
    return record_pairs(*linked_forms(registry, barangays), "iis_a", "iis_b")


def address_classes(registry: DataFrame, barangays: DataFrame) -> DataFrame:
    """(iis_no, class_id, n_members, n_links): one row for each record and form of its addresses; see `pairs.classes`."""
    return classes(*linked_forms(registry, barangays), "iis_no")
