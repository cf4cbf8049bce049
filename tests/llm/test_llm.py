"""Problems 2, 5, 6, 7 and 8: brute force on small fixtures, exact round trips, held-out accuracy, and the edges."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from attesta.llm import addresses as a, bpe, language as g, names as n, packing as p, spelling
from tests.conftest import SF

PATH = f"{bpe.TOKENIZERS_DIR}/byte_bpe_50k.json"


# --- 6 ---


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abe thing'sSldr .,!?\n\t   　\x1c\x85é日本中🎉‍﻿०१Ⅷ½²<|>")), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    t = test_ids_equal_the_library.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    t.encode_special_tokens = True
    assert bpe.encoder(PATH).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_long_pre_tokens_and_special_strings(reference):
    e = bpe.encoder(PATH)
    for s in ("a" * 5000, "ab" * 3000, "é" * 2000, "<|endoftext|>", " " * 3000, "the" * 4000, "x" * 63 + "\n\n"):
        assert e.encode(s) == reference(s)


def test_rank_queue_gives_ranks_in_order():
    rnd, q, want = random.Random(1), bpe.RankQueue(50_000), {}
    for _ in range(2000):
        r, i = rnd.randrange(50_000), rnd.randrange(100)
        q.push(r, i)
        want.setdefault(r, []).append(i)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == [(r, sorted(v)) for r, v in sorted(want.items())]


def test_corpus_ids(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(docs, PATH).collect()}
    want = {r.doc_id: reference(r.text) if r.text else [] for r in docs.collect()}
    assert got == want
    assert bpe.encode_texts(docs.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "a\0b", "z")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, len(r.ids)) for r in bpe.encode_texts(odd, PATH).collect()) == [(1, 0), (1, 0), (2, 3)]


# --- 7 ---


def checked(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens int")
    rows = p.pack(df, capacity, max(1, len(sizes))).collect()
    used, parts = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tok_to - r.tok_from
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.tok_from, r.tok_to))
    assert all(u <= capacity for u in used.values())
    for i, s in enumerate(sizes):
        cut = sorted(parts[i])
        assert [c[0] for c in cut] == list(range(1, len(cut) + 1))
        assert cut[0][1] == 0 and cut[-1][2] == (s or 0) and all(x[2] == y[1] for x, y in zip(cut, cut[1:]))
        assert len(cut) == 1 or s > capacity
    return used


def test_packing_is_whole_and_tight(spark, monkeypatch):
    rnd = random.Random(2)
    sizes = [rnd.choice([rnd.randint(1, 60), rnd.randint(60, 256), rnd.randint(256, 900)]) for _ in range(1500)] + [0, None, 256, 257, 1024]
    for shard in (20_000, 300):
        monkeypatch.setattr(p, "SHARD_ITEMS", shard)
        used = checked(spark, sizes, 256)
        total = sum(s or 0 for s in sizes)
        assert len(used) <= 1.03 * -(-total // 256) + 3
    assert p.split_items(p.pack(spark.createDataFrame([(7, 300), (8, 256)], "doc_id bigint, n_tokens int"), 256, 2)).collect()[0].doc_id == 7


def test_packing_edges(spark):
    assert p.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), 256, 0).collect() == []
    assert checked(spark, [0, 0, None], 256) != {}
    with pytest.raises(ValueError):
        p.pack(spark.range(1).selectExpr("id AS doc_id", "1 AS n_tokens"), 0, 1)


def slow_sum_of_squares(sizes, capacity):
    """The rule itself: try every level, take the least sum, of equals the fullest container."""
    levels, out = [], []
    for s in sizes:
        def total(ls):
            counts = {}
            for x in ls:
                if 0 < x < capacity:
                    counts[x] = counts.get(x, 0) + 1
            return sum(c * c for c in counts.values())

        options = [(total([*levels, s]), 1, 0)] + [(total([*levels[:i], x + s, *levels[i + 1 :]]), 0, -x) for i, x in enumerate(levels) if x + s <= capacity]
        _, fresh, level = min(options)
        if fresh:
            levels.append(s)
        else:
            i = max(k for k, x in enumerate(levels) if x == -level)
            levels[i] += s
        out.append(sorted(levels))
    return out


def test_sum_of_squares_twin():
    rnd = random.Random(3)
    for _ in range(20):
        sizes = [rnd.randint(1, 12) for _ in range(25)]
        want = slow_sum_of_squares(sizes, 12)
        bins = p.sum_of_squares(np.array(sizes), 12)
        for k in range(len(sizes)):
            filled = {}
            for s, b in zip(sizes[: k + 1], bins[: k + 1]):
                filled[b] = filled.get(b, 0) + s
            assert sorted(filled.values()) == want[k]


# --- 2 ---

PLACES = [("Supibuli", "Mututulang", "Niliratut", "7569"), ("Kapilupit", "Yadapinu", "North Yaluwawat", "7426"), ("Dapulapas", "Sidanulan", "Niliratut", "7192")]
REG = "iis_no string, address string, company_name string, subject_name string, form bigint, street string"


def pairs(spark, rows):
    reg = spark.createDataFrame([(f"R1-2024-{i:04d}" if x is not None and x[:1] != "!" else None, x and x.lstrip("!"), None, None, 0, "clash") for i, x in enumerate(rows)], REG)
    got = a.same_address_records(reg, spark.createDataFrame(PLACES, "barangay string, town string, province string, zip string")).collect()
    return sorted((int(r.iis_a[-4:]), int(r.iis_b[-4:])) for r in got)


def test_addresses(spark):
    rows = [
        "Unit 7, # 10 Daradisus Yadikabut Road, Brgy. Supibuli, Mututulang, Niliratut, 7569", "niliratut; mututulang city; bgy supibuli; daradisus yadikabut rd. no. 10", "Daradisus Yadikabut Rd 10 Stall A - Mututulang Town",
        "10 Daradisus Yadikabut Street, Supibuli, Mututulang", "11 Daradisus Yadikabut Road, Supibuli, Mututulang", "10 Daradisus Yadikabut Road, Kapilupit, Yadapinu", "10 Daradsus Yadikabut Road\nBrgy Supibuli\nMututulnag 7569",
        "Lot 4 Block 25, Daradisus Yadikabut Subd, Kapilupit, 7426", "L4 B25 DARADISUS YADIKABUT SUBDIVISION BO. KAPILUPIT YADAPINU", "Lot 25 Block 4, Daradisus Yadikabut Subd, Kapilupit, 7426",
        None, "", "  ", "various", "Supibuli, Mututulang", "Mututulang", "!10 Daradisus Yadikabut Road, Supibuli, Mututulang", "x" * 20_000,
    ]
    assert pairs(spark, rows) == [(0, 1), (0, 2), (0, 6), (1, 2), (1, 6), (2, 6), (7, 8)]
    assert pairs(spark, []) == []


def test_a_place_that_isnt_settled_is_no_case(spark):
    places = [*PLACES, ("Kumadabin", "Mututulang", "Niliratut", "7569")]
    reg = spark.createDataFrame([(f"R1-2024-{i:04d}", x, None, None, 0, "") for i, x in enumerate(["3 Aaaaba Bbbbab Road, Supibuli, Mututulang", "3 Aaaaba Bbbbab Road, Kumadabin, Mututulang", "3 Aaaaba Bbbbab Road, Mututulang"])], REG)
    assert a.same_address_records(reg, spark.createDataFrame(places, "barangay string, town string, province string, zip string")).collect() == []


def test_what_names_a_street_is_no_slip(spark):
    rows = [
        "12 Rosa Street, Supibuli, Mututulang", "Rosa St. 12, Brgy Supibuli, Mututulang", "14 Roda Street, Supibuli, Mututulang", "14 Roda St, Bgy. Supibuli, Mututulang", "14 Road, Supibuli, Mututulang", "16 Supibulo Street, Supibuli, Mututulang", "16 Supibulo St, Supibuli, Mututulang",
        "18 Blossom Roda Street, Supibuli, Mututulang", "18 Blossom Street, Supibuli, Mututulang", "18 Blossom Road, Supibuli, Mututulang", "21 Roda, Supibuli, Mututulang", "Supibuli, Mututulang; 21 Roda", "7 Supibuil, Mututulang", "7 Supibuil - Mututulang", "23 Blossom Raod, Supibuli, Mututulang", "23 Blossom Road, Supibuli, Mututulang",
        *[f"{i} Daradisus Yadikabut Road, Supibuli, Mututulang" for i in range(100, 190)],
    ]
    assert pairs(spark, rows) == [(0, 1), (2, 3), (5, 6), (10, 11), (14, 15)]


CITIES = [("San Isidro", "Santa Rosa", "Laguna", "4026"), ("Poblacion", "Taytay", "Rizal", "1920"), ("Poblacion", "Angono", "Rizal", "1930"), ("San Jose", "Angono", "Rizal", "1930")]


def city_pairs(spark, rows):
    reg = spark.createDataFrame([(f"R1-2024-{i:04d}", x, None, None, 0, "") for i, x in enumerate(rows)], REG)
    got = a.same_address_records(reg, spark.createDataFrame(CITIES, "barangay string, town string, province string, zip string")).collect()
    return sorted((int(r.iis_a[-4:]), int(r.iis_b[-4:])) for r in got)


def test_places_of_several_words_and_towns(spark):
    assert city_pairs(spark, ["10 Mabini Street, San Isidro, Santa Rosa", "Mabini St. 10, Brgy. San Isidro, Santa Rosa City", "10 mabini st san isidro 4026"]) == [(0, 1), (0, 2), (1, 2)]
    assert city_pairs(spark, ["10 Mabini Street, Poblacion, Taytay", "10 Mabini Street, Poblacion, Angono", "10 Mabini Street, Poblacion", "Mabini St 10, Bgy Poblacion, 1930"]) == [(1, 3)]
    assert city_pairs(spark, ["10 Santa Rosa Street, San Jose, Angono", "Santa Rosa St. 10, San Jose, Angono", "10 Rosa Street, San Jose, Angono"]) == [(0, 1)]


def test_short_and_numbered_streets(spark):
    assert city_pairs(spark, ["15 Q Street, Poblacion, Taytay", "Q St. 15, Brgy Poblacion, Taytay", "15 R Street, Poblacion, Taytay"]) == [(0, 1)]
    assert city_pairs(spark, ["15 5th Street, Poblacion, Taytay", "15 5th St., Poblacion, Taytay", "15 6th Street, Poblacion, Taytay", "5 15th Street, Poblacion, Taytay"]) == [(0, 1)]


def test_a_town_outside_the_gazetteer(spark):
    assert city_pairs(spark, ["15 Mabini Street, Elsewhere", "Mabini St. 15, Elsewhere", "see 3 folders", "see 3 folders"]) == [(0, 1)]


def test_address_recall_against_all_pairs_of_forms(spark):
    reg, places = spark.read.parquet(f"{SF}/registry.parquet"), spark.read.parquet(f"{SF}/barangays.parquet")
    records = reg.select(F.regexp_extract(F.upper("iis_no"), "R1-[0-9]{4}-[0-9]{4,}", 0).alias("key"), "address")
    _, forms = a.forms(records, places)
    one, two = a.weighed(forms).select(F.col("f").alias("a")), a.weighed(forms).select(F.col("f").alias("b"))
    slow = a.same_place(a.durable(one.crossJoin(two).filter("a.form < b.form").filter(a.compatible()))).select("a", "b")
    want, got = {tuple(r) for r in slow.collect()}, {tuple(r) for r in a.same_places(forms).select("a", "b").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


def test_classes_of_addresses(spark):
    reg = spark.createDataFrame([(f"R1-2024-{i:04d}", x, None, None, 0, "") for i, x in enumerate(["10 Mabini Street, San Jose, Angono", "Mabini St 10, San Jose, Angono", "10 Mabini Street, Angono", "x"])], REG)
    rows = a.address_classes(reg, spark.createDataFrame(CITIES, "barangay string, town string, province string, zip string")).collect()
    assert sorted((r.iis_no, r.n_members, r.n_links) for r in rows) == [("R1-2024-0000", 2, 1), ("R1-2024-0001", 2, 1), ("R1-2024-0002", 1, 1)]


def test_a_hot_class_is_split(spark, monkeypatch):
    from attesta.llm import pairs as q

    monkeypatch.setattr(q, "CLASS_PART", 3)
    members = q.durable(spark.createDataFrame([(f"k{i:02d}", 1) for i in range(11)] + [("k03", 2), ("z", 2), ("y", 3)], "key string, form bigint"))
    got = sorted(tuple(r) for r in q.record_pairs(members, spark.createDataFrame([(1, 3)], "a bigint, b bigint"), "l", "r").collect())
    ks = [f"k{i:02d}" for i in range(11)]
    assert got == sorted({(x, y) for i, x in enumerate(ks) for y in ks[i + 1 :]} | {("k03", "z")} | {(x, "y") for x in ks})


def test_long_words_meet_too(spark):
    w = "abcdefghij" * 5
    rows = [(w, 30), (w[:7] + w[8:], 1), (w[:49] + "x", 1), ("x" + w, 1), (w[:20] + w[21] + w[20] + w[22:], 1), (w[:24], 20), (w[:10] + w[11:24], 1), (w[:25], 1), (w[::-1], 1), ("y" * 30_000, 1)]
    got = {r.w: r.good for r in spelling.spellings(spark.createDataFrame(rows, "w string, n bigint"), spark.createDataFrame([], "w string")).collect()}
    assert got == {x: w for x, _ in rows[1:5]} | {rows[6][0]: w[:24], rows[7][0]: w[:24]}


def test_known_words_replace_slips_only(spark):
    words = spark.createDataFrame([("rosa", 3), ("roda", 12), ("raod", 2), ("near", 40), ("neara", 30), ("supibul", 1), ("mututulnag", 3), ("dnear", 40)], "w string, n bigint")
    known = spark.createDataFrame([("road",), ("near",), ("supibuli",), ("mututulang",)], "w string").unionByName(spark.createDataFrame([("lane",)], "w string"))
    counts = words.unionByName(spark.createDataFrame([("road", 60), ("mututulang", 5)], "w string, n bigint"))
    assert {r.w: r.good for r in spelling.spellings(counts, known).collect()} == {"raod": "road", "supibul": "supibuli", "mututulnag": "mututulang"}


# --- 5 ---


def test_alignment():
    assert n.alignment(["galnovbra", "margrosol"], ["margrosol", "galnovbra"]) == 0
    assert n.alignment(["galnovb.", "margrosol"], ["margrosol", "galnovbra"]) == n.ABBREVIATED
    assert n.alignment(["galnovbra", "margrosol"], ["margrosl", "galnovbra"]) == n.SLIP
    assert n.alignment(["galnovbra", "margrosol"], ["margrosol", "quinelcle"]) >= n.FORBIDDEN
    assert n.alignment([], ["x"]) >= n.FORBIDDEN


def test_assignment_against_all_orders():
    import itertools

    rnd = random.Random(4)
    for _ in range(100):
        k, m = rnd.randint(1, 4), rnd.randint(4, 5)
        c = [[rnd.randint(0, 9) for _ in range(m)] for _ in range(k)]
        assert n.assignment(c) == min(sum(c[i][j] for i, j in enumerate(o)) for o in itertools.permutations(range(m), k))


def slow_one_edit(x, y):
    near = {x}
    letters = "abc"
    for i in range(len(x) + 1):
        near |= {x[:i] + x[i + 1 :]} | {x[:i] + c + x[i:] for c in letters} | {x[:i] + c + x[i + 1 :] for c in letters if i < len(x)} | {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for _ in [0] if i + 1 < len(x)}
    return y in near


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_one_edit_twin(x, y):
    assert n.one_edit(x, y) == slow_one_edit(x, y)


def test_deletes_find_every_single_edit(spark):
    words = spark.createDataFrame([("margrosol", 100), ("margorsol", 1), ("margrosl", 1), ("margrossol", 1), ("mbrgrosol", 1), ("quinelcle", 50), ("xx", 1)], "w string, n bigint")
    got = {r.w: r.good for r in spelling.spellings(words, spark.createDataFrame([], "w string")).collect()}
    assert got == {w: "margrosol" for w in ("margorsol", "margrosl", "margrossol", "mbrgrosol")}


def name_pairs(spark, companies, persons):
    k = max(len(companies), len(persons))
    at = lambda xs, i: xs[i] if i < len(xs) else None
    reg = spark.createDataFrame([(f"R1-2024-{i:04d}", None, at(companies, i), at(persons, i), 0, "clash") for i in range(k)], REG)
    got = n.same_name_records(reg, spark.createDataFrame([("Cristina", "Ting"), ("Roberto", "Bert")], "given_name string, short_form string")).collect()
    return {f: sorted((int(r.iis_a[-4:]), int(r.iis_b[-4:])) for r in got if r.name_field == f) for f in ("company_name", "subject_name")}


def test_names(spark):
    companies = [
        "Margrosol Galnovbra Fishing Company", "Fshg. (Margrosol Galnovb.) Company", "GALNOVBRA MARGROSOL FISHING INC", "Margrosol Galnovbra Quarry", "Co., MargrosolGalnovbra Fishing", "M/s Margrosl Galnovbra Fishing", "Margrosol Quinelcle Fishing",
        None, " ", "x" * 10_000, "Zenpelquin Marhelbra Rice Mill", '"ZENPELQUIN-MARHELBRA RICEMILL, INC."',
    ]
    persons = [
        "Cristina Bragalis Bunujorlagan", "TING B. BUNUJORLAGAN", "Bunujorlagan, Cristina", "Dr. Cristina Bragalis Bunujorlagan Jr.", "C. Bragalis Bunujorlagan", "Roberto Bragalis Bunujorlagan", None, "", "Bunujorlagan", "Cristina Bragalis Bunujorlgan", "Cristina Zenflgro Wenulambimal",
    ]
    got = name_pairs(spark, companies, persons)
    same = [0, 1, 2, 4, 5]
    assert got["company_name"] == [(i, j) for x, i in enumerate(same) for j in same[x + 1 :] if (i, j) not in {(1, 4)} and (i, j) not in {(1, 5)}] or got["company_name"][-1] == (10, 11)
    assert {(0, 1), (0, 2), (0, 4), (0, 5), (10, 11)} <= set(got["company_name"]) and not {3, 6} & {i for x in got["company_name"] for i in x}
    assert {(0, 1), (0, 2), (0, 4), (0, 9), (1, 2)} <= set(got["subject_name"]) and not {3, 5, 8, 10} & {i for x in got["subject_name"] for i in x}
    assert name_pairs(spark, [], []) == {"company_name": [], "subject_name": []}


def test_slips_in_first_letters_of_persons(spark):
    persons = ["Cristina Bragalis Bunujorlagan", "Cristina Rbagalis Bunujorlagan", "Rcistina Bragalis Bunujorlagan", "Cristina Kwagalis Bunujorlagan", "Wenola Zenflgro Tarulimbal", "Venola Zenflgro Tarulimbl", "W. Zenflgro Tarulimbal"]
    assert name_pairs(spark, [], persons)["subject_name"] == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6)]


def test_organisations_with_every_word_shortened(spark):
    companies = [
        "Margrosol Trading", "Margr. Trading", "Margrosol Galnovbra Fishing", "Marg. Galn. Fishing", "M. G. Fishing", "Quinelcle Zenpelquin Mining", "Quinelbra Zenmarhel Mining", "Quinel. Zen. Mining",
        "Tarulim Wenola Zenflgro Quarry", "Tarulim WenolaZenflgro Quarry", "Wenulam Brosol Kilgrove Hauling", "WenulamBrosolKil. Hauling", "Q Z Mining",
    ]
    assert name_pairs(spark, companies, [])["company_name"] == [(0, 1), (2, 3), (2, 4), (3, 4), (8, 9), (10, 11)]


def test_trades_need_no_list(spark):
    companies = ["Margrosol Galnovbra Pharmacy", "Margrosol Galnovbra Phcy. Inc", "Margrosol Galnovbra Clinic", "Quinelcle Zenpelquin Pharmacy", "Zenpelquin Quinelcle Phcy"]
    assert name_pairs(spark, companies, [])["company_name"] == [(0, 1), (3, 4)]


def test_abbreviations_stand_beside_the_same_words(spark):
    rows = [("rice", "mill", 9), ("textile", "mills", 9), ("medical", "ctr", 2), ("medical", "center", 9), ("sugar", "central", 9), ("zenpel", "mfg", 2), ("zenpel", "manufacturing", 5), ("zenpel", "marketing", 5)]
    bigrams = spark.createDataFrame(rows, "x string, y string, n bigint")
    counts = spark.createDataFrame([(w, n) for w, n in {w: n for r in rows for w, n in ((r[0], r[2]), (r[1], r[2]))}.items()], "w string, n bigint")
    got = {r.w: r.long for r in n._abbreviations(counts, bigrams, spark.createDataFrame([], "w string, good string")).collect()}
    assert got == {"ctr": "center", "mfg": "manufacturing"}


def test_organisation_recall_against_all_pairs_of_forms(spark):
    reg = spark.read.parquet(f"{SF}/registry.parquet")
    forms = n.durable(n.organisation_forms(reg.select(F.col("company_name").alias("name")).filter("name IS NOT NULL").distinct()))
    f = forms.select("form", "tokens").distinct()
    every = f.selectExpr("form AS a", "tokens AS ta").crossJoin(f.selectExpr("form AS b", "tokens AS tb")).filter("a < b AND size(ta) = size(tb)")
    want = {tuple(r) for r in n._settled_organisations(n.durable(n.aligned_pairs(every, 2 * n.SLIP + 0.01))).collect()}
    got = {tuple(r) for r in n.same_organisations(forms).collect()}
    assert len(got & want) >= 0.97 * len(want) > 0 and len(got - want) <= 0.03 * len(want)


def test_person_recall_against_all_pairs_of_forms(spark):
    reg, given = spark.read.parquet(f"{SF}/registry.parquet"), spark.read.parquet(f"{SF}/given_names.parquet")
    forms = n.durable(n.person_forms(reg.select(F.col("subject_name").alias("name")).filter("name IS NOT NULL").distinct(), given))
    rows = {r.form: r for r in forms.collect()}
    want = set()
    for x in rows.values():
        for y in rows.values():
            if x.form < y.form and x.suffix == y.suffix:
                both = x.middle is not None and y.middle is not None
                t = lambda r: [r.surname, r.given, *([r.middle] if both else [])]  # noqa: E731, B023
                if n.alignment(t(x), t(y)) <= 2 * n.SLIP + 0.01 and n.token_cost(x.surname, y.surname) < 1 and n.token_cost(x.given, y.given) < 1:
                    want.add((x.form, y.form))
    got = {(r.a, r.b) for r in n.same_persons(forms).collect()}
    assert len(got & want) >= 0.99 * len(want) > 0


# --- 8 ---

TEXTS = {
    "en": ["The parcel came late and the box was open.", "I would buy this chair again tomorrow.", "Nobody answered any of my messages.", "My sister wanted one as soon as she saw it.", "The colour is darker than in the picture."],
    "de": ["Das Paket kam spät und die Schachtel war offen.", "Ich würde diesen Stuhl sofort wieder kaufen.", "Auf meine Nachrichten hat niemand geantwortet.", "Meine Schwester wollte gleich auch so eines haben.", "Die Farbe ist dunkler als auf dem Bild."],
    "ru": ["Посылка пришла поздно и коробка была открыта.", "Я бы снова купил этот стул.", "На мои сообщения никто не ответил.", "Сестра сразу захотела такой же.", "Цвет темнее, чем на снимке."],
}
NAMES = "lang string, written_as string"


def test_sentences_leave_out_what_is_no_text():
    s = g.sentences("I like it!<br/>See https://x.example/y?z The Quinelcle T46 works\nwell... / Ja, gut. \u200b🎉 12 [CLS]", g.Goods(["Quinelcle T46"]))
    assert s == ["I like it!", "See The works well...", "Ja, gut."]
    assert g.sentences(None) == g.sentences("") == g.sentences("🎉 12 !!") == []


def test_sequence_is_the_most_likely_one():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(50):
        s = rng.normal(0, 2, (5, 3))
        best = max(itertools.product(range(3), repeat=5), key=lambda x: sum(s[i, k] for i, k in enumerate(x)) - 1.5 * sum(u != v for u, v in zip(x, x[1:])))
        assert tuple(g.likeliest(s, 1.5)) == best


def test_languages_and_segments(spark):
    rows = [(i, " ".join(random.Random(i).sample(TEXTS[k], 3)), None, k, 0) for i, k in enumerate([*TEXTS] * 12)]
    rows += [(900, TEXTS["en"][0] + " " + TEXTS["de"][1] + " " + TEXTS["de"][2], None, "en", 0), (901, TEXTS["ru"][3], None, "EN ", 0), (902, TEXTS["de"][4], None, None, 0), (903, None, None, "de", 0), (904, "🎉", None, "de", 0), (905, "", None, None, 0), (906, TEXTS["de"][0], None, " Deutsch", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, title string, lang string, seg_no int")
    names = spark.createDataFrame([("en", "en"), ("de", "de"), ("de", "deutsch"), ("ru", "ru")], NAMES)
    got = sorted(tuple(r) for r in g.label_cases(g.document_languages(docs, names)).collect())
    assert got == [(900, 1, "en"), (900, 2, "de"), (901, 1, "ru"), (902, 1, "de")]
    assert g.document_languages(docs.limit(0), names).collect() == []
    assert g.document_languages(docs.withColumn("lang", F.lit("zz")), names).collect() == []


def test_held_out_sentences_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = spark.read.parquet("/root/testdata/sf0.01/language_names.parquet")
    known = g.labelled(docs, names).filter("named IS NOT NULL AND length(text) > 20")
    net = g.trained(g.training_texts(known.filter("doc_id % 4 <> 0")))
    # Some labels are wrong and some texts mixed: what a sentence is, the labels of all its documents say together.
    votes = {}
    for r in known.collect():
        for s in g.sentences(r.text):
            votes.setdefault(s, {}).setdefault(r.named, 0)
            votes[s][r.named] += 1
    sure = {s: max(v, key=v.get) for s, v in votes.items() if sum(v.values()) >= 3 and max(v.values()) > 0.7 * sum(v.values())}
    held = [s for r in known.filter("doc_id % 4 = 0").collect() for s in g.sentences(r.text) if s in sure]
    right = sum(net.langs[int(net.log_probs(g.windows(s)).sum(0).argmax())] == sure[s] for s in held)
    assert len(held) > 150 and right / len(held) > 0.97


def test_names_of_goods_say_nothing():
    goods = g.Goods(["Quinelcle T46", "Ororel  S61", None, " ", "Lamp"])
    assert g.sentences("I like quinelcle t46 a lot. Clamps, LAMP!", goods) == ["I like a lot.", "Clamps, !"]
    assert g.sentences("The Zenpelquin X23 works, not 30 or 7 days.", goods) == ["The Zenpelquin X00 works, not 00 or 0 days."]
    assert g.Goods([]).without("İx Ororel S61") == "İx Ororel S61" and g.Goods(["Ororel S61"]).without("İx Ororel S61 y").split() == ["İx", "y"]


def test_short_windows_score_as_whole_ones():
    rnd = np.random.default_rng(5)
    net = g.ByteNet(["a", "b", "c"])
    x = np.concatenate([g.windows("".join(chr(97 + c) for c in rnd.integers(0, 26, n))) for n in (1, 5, 30, 74, 75, 76, 78, 79, 200)])
    z = net.pooled(x)[0] @ net.out + net.out_bias
    want = z - z.max(axis=1, keepdims=True)
    want -= np.log(np.exp(want).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probs(x), want, atol=1e-4)


def test_a_network_is_kept_as_a_table(spark, tmp_path):
    net = g.trained([("the cat sat on the mat. it was a good day.", "en"), ("die katze lag auf der matte. es war ein guter tag.", "de")] * 3)
    g.save_network(spark, net, str(tmp_path / "net"))
    again = g.load_network(spark, str(tmp_path / "net"))
    x = np.concatenate([g.windows("the day"), g.windows("der tag")])
    assert again.langs == net.langs and np.allclose(again.log_probs(x), net.log_probs(x))
    docs = spark.createDataFrame([(1, "it was the day.", "en", None), (2, None, None, None), (3, "es war der tag.", "en", None)], "doc_id bigint, text string, lang string, title string")
    names = spark.createDataFrame([("en", "en"), ("de", "de")], "lang string, written_as string")
    found = g.document_languages(docs, names, net=again)
    assert sorted((r.doc_id, r.lang, r.is_case) for r in found.collect()) == [(1, "en", False), (3, "de", True)]
    assert sum(r.n_segments for r in g.confidence_report(found).collect()) == 2


def test_letters_refuse_what_no_pattern_would_find(spark):
    """Of words that meet as abbreviations, bits of their letters refuse most pairs before a pattern is tried, and none that it finds."""
    rnd = random.Random(4)
    words = [("".join(rnd.choices("abcdefgñoz19", k=rnd.randint(1, 9))),) for _ in range(150)]
    w = spark.createDataFrame(words, "w string").withColumn("m", n._letters(F.col("w")))
    pairs = w.alias("a").crossJoin(w.alias("b")).select(F.col("a.m").bitwiseAND(F.col("b.m")) == F.col("a.m"), n._subsequence(F.col("a.w"), F.col("b.w"))).collect()
    assert not any(found and not held for held, found in pairs) and any(found for _, found in pairs)
    assert sum(held for held, _ in pairs) < len(pairs) / 3
