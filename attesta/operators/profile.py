"""Column-level data quality profile (problem 3): expressions induced by minimum description length, and what breaks them.

Over all values, each with its number of rows, the alternatives of a column's expression compete:

- a pattern of fixed length: the value's characters as classes (upper case, lower case, digit, space; other signs stand for
  themselves), a run of one class literal where that is shorter;
- the same with runs of any length;
- a list that a reference table holds, which costs its name;

and in either pattern the value of another column of the same row, where it occurs, is one sign: a placeholder. A row costs 8
bits a character written out; through an alternative it costs the bits of the open classes (or the number within the list)
and of naming the alternative. The alternative that saves most enters, then the next among the rows still written out, as
long as it saves more than its own text and, in more than half of the loads, at least LEAST_GAIN of the load's description.
So neither a habit of one load nor a mistake that is made again and again becomes the form.

Values are counted by signature in one aggregation; what comes to the driver is bounded: in each load at most 1 / LEAST_GAIN
alternatives of a kind hold that share, and each has to in half of the loads.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.keys import canonical_no, is_blank
from attesta.sources.durable import durable

#: A load differs when a share is further than this from the median over all loads.
SHARE_STEP = 0.2
#: An alternative shortens the description of most loads by at least this share.
LEAST_GAIN = 0.05
#: Values of a reference list at most; they are literals of the plan.
MOST_LISTED = 10_000
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASSES = {"U": ("[A-Z]", math.log2(26)), "l": ("[a-z]", math.log2(26)), "d": ("[0-9]", math.log2(10)), "s": (r"\s", 1.0)}
_SPACES = " \t\n\r\x0b\x0c"


class Alternative(NamedTuple):
    """One alternative of an expression: a regular expression over the value with placeholders, or the name of a list."""

    text: str
    is_list: bool
    rows: int


Expressions = Mapping[str, Sequence[Alternative]]


def _mark(i: int) -> str:
    return chr(0xE000 + i)


def with_placeholders(value: Column, others: Mapping[str, Column]) -> Column:
    """The value with what the row has in `others` (texts of 4 or more characters) replaced by one sign each."""
    marks = "".join(_mark(i) for i in range(len(others)))
    out = F.translate(value, marks, "�" * len(marks)) if others else value
    for i, c in enumerate(others.values()):
        out = F.when(F.length(c) >= 4, F.replace(out, c, F.lit(_mark(i)))).otherwise(out)
    return out


def signature(value: Column) -> Column:
    """The value with each character as its class."""
    return F.translate(value, _UPPER + _LOWER + _DIGITS + _SPACES, "U" * 26 + "l" * 26 + "d" * 10 + "s" * len(_SPACES))


def _loose(sig: Column) -> Column:
    return F.regexp_replace(sig, r"([Ulds])\1+", "$1")


def _runs(sig: str) -> list[tuple[str, int, int]]:
    """(class or sign, start, length) of each run of a signature; a sign is a run of its own."""
    return [(m[0][0], m.start(), len(m[0])) for m in re.finditer(r"U+|l+|d+|s+|[^Ulds]", sig, re.S)]


def _listed(value: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, values in lists.items():
        out = F.when(value.isin(list(values)), F.lit(name)).otherwise(out)
    return out


def _fields(columns: Sequence[str], others: Mapping[str, Column]) -> dict[str, tuple[Column, Column]]:
    """For each column its value as text and with placeholders; a column is no placeholder of itself."""
    return {c: (F.col(c).cast("string"), with_placeholders(F.col(c).cast("string"), {n: x for n, x in others.items() if n != c})) for c in columns}


def signature_counts(rows: DataFrame, load: str, columns: Sequence[str], others: Mapping[str, Column], lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """(load, field_name, listed, sig, n) over the values that aren't blank: counts are added up in each task before the shuffle."""
    each = F.array(*[F.struct(F.lit(c).alias("field_name"), _listed(v, lists).alias("listed"), F.when(~is_blank(v), signature(t)).alias("sig")) for c, (v, t) in _fields(columns, others).items()])
    return rows.select(F.col(load).alias("load"), F.explode(each).alias("x")).select("load", "x.*").filter("sig IS NOT NULL").groupBy("load", "field_name", "listed", "sig").agg(F.count("*").alias("n"))


def _list_bits(values: Sequence[str]) -> float:
    return math.log2(max(2, len(values)))


def _candidates(counts: DataFrame, lists: Mapping[str, Sequence[str]], least_gain: float) -> list:
    """Alternatives that could save enough in more than half of the loads, as rows (field_name, kind, key, n, chars).

    A list that saves more than any pattern of its field could enters first; then only patterns count that could still save
    enough among the values that aren't listed.
    """
    c = counts.withColumn("bits", 8 * F.length("sig") * F.col("n"))
    whole = c.groupBy("load", "field_name").agg(F.sum("bits").alias("whole"))
    loads = whole.groupBy("field_name").agg(F.count("*").alias("loads"))
    named = F.lit(0.0)
    for name, values in lists.items():
        named = F.when(F.col("listed") == name, F.lit(_list_bits(values) + 1)).otherwise(named)
    kind = lambda name, key, cost: F.struct(F.lit(name).alias("kind"), key.alias("key"), (cost * F.col("n")).alias("cost"))
    kinds = F.array(kind("list", F.col("listed"), named), kind("fixed", F.col("sig"), F.lit(0.0)), kind("loose", _loose(F.col("sig")), F.lit(0.0)))
    each = c.withColumn("k", F.explode(kinds)).select("*", "k.*").filter("key IS NOT NULL").groupBy("load", "field_name", "kind", "key").agg(
        F.sum("bits").alias("bits"), F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum(F.when(F.col("listed").isNull(), F.col("bits")).otherwise(0)).alias("rest"))
    enough = lambda x: F.count_if(x >= least_gain * F.col("whole"))
    held = each.join(whole, ["load", "field_name"]).groupBy("field_name", "kind", "key").agg(
        enough(F.col("bits") - F.col("cost")).alias("good"), enough(F.col("rest")).alias("good_rest"), F.sum("n").alias("n"), (F.sum("bits") / 8).alias("chars"), F.sum("cost").alias("cost"))
    found = held.join(loads, "field_name").filter("2 * good > loads").collect()
    for field in {r["field_name"] for r in found}:
        own = [r for r in found if r["field_name"] == field]
        first = [r for r in own if r["kind"] == "list"]
        if len(first) == 1 and all(8 * first[0]["chars"] - first[0]["cost"] - 8 * len(first[0]["key"]) >= 8 * r["chars"] for r in own if r["kind"] != "list" and 2 * r["good_rest"] <= r["loads"]):
            found = [r for r in found if r["field_name"] != field or r["kind"] == "list" or 2 * r["good_rest"] > r["loads"]]
    return found


def _regex(sig: str, loose: bool, literal: Mapping[int, str]) -> str:
    text = ""
    for i, (kind, _, length) in enumerate(_runs(sig)):
        if i in literal:
            text += re.escape(literal[i])
        elif kind in _CLASSES:
            text += _CLASSES[kind][0] + ("+" if loose else f"{{{length}}}" if length > 1 else "")
        else:
            text += re.escape(kind)
    return text


def _group_regex(sig: str) -> str:
    return "^" + "".join(f"({_CLASSES[k][0]}+)" if k in _CLASSES else f"({re.escape(k)})" for k, *_ in _runs(sig)) + r"\z"


def _common_runs(rows: DataFrame, columns: Sequence[str], others: Mapping[str, Column], found: list) -> dict[tuple, tuple[str, int, float]]:
    """For each open run of each pattern its most common text, about how many rows have it, and the mean length of the run, by frequency sketches in one pass."""
    fields, wanted = _fields(columns, others), []
    used = [c for c in columns if any(r["field_name"] == c and r["kind"] != "list" for r in found)]
    # Values, signatures and loose signatures once a row; the runs are cut out of them.
    rows = rows.select(*[fields[c][1].alias(f"t{i}") for i, c in enumerate(used)]).select("*", *[signature(F.col(f"t{i}")).alias(f"s{i}") for i in range(len(used))])
    rows = rows.select("*", *[_loose(F.col(f"s{i}")).alias(f"u{i}") for i in range(len(used))])
    for r in found:
        if r["kind"] == "list":
            continue
        k = used.index(r["field_name"])
        for i, (kind, start, length) in enumerate(_runs(r["key"])):
            if kind not in _CLASSES:
                continue
            if r["kind"] == "fixed":
                run = F.when(F.col(f"s{k}") == r["key"], F.substring(f"t{k}", start + 1, length))
            else:
                run = F.when(F.col(f"u{k}") == r["key"], F.regexp_extract(f"t{k}", _group_regex(r["key"]), i + 1))
            wanted.append(((r["field_name"], r["kind"], r["key"], i), run))
    out: dict[tuple, tuple[str, int, float]] = {}
    for at in range(0, len(wanted), 40):
        part = wanted[at : at + 40]
        named = rows.select(*[run.alias(f"r{k}") for k, (_, run) in enumerate(part)])
        tops = named.agg(*[F.expr(f"approx_top_k(r{k}, 2, 1000) FILTER (WHERE r{k} IS NOT NULL)").alias(f"r{k}") for k in range(len(part))], *[F.avg(F.length(f"r{k}")).alias(f"l{k}") for k in range(len(part))]).head()
        for k, (key, _) in enumerate(part):
            best = [e for e in tops[f"r{k}"] or [] if e["item"] is not None]
            if best:
                out[key] = (best[0]["item"], best[0]["count"], tops[f"l{k}"])
    return out


def induce_expressions(rows: DataFrame, load: str, columns: Sequence[str], others: Mapping[str, Column] | None = None, lists: Mapping[str, Sequence[str]] | None = None, least_gain: float = LEAST_GAIN) -> dict[str, list[Alternative]]:
    """For each column the alternatives of its expression, in the order in which they entered. No column without values has one.

    others: what of the row a pattern may refer to, by name. lists: reference lists by name. Rows without a load count as a
    load of their own.
    """
    others, lists = others or {}, {n: [v for v in dict.fromkeys(vs) if v is not None] for n, vs in (lists or {}).items()}
    lists = {n: vs for n, vs in lists.items() if vs}
    if any(len(v) > MOST_LISTED for v in lists.values()):
        raise ValueError(f"a reference list has more than {MOST_LISTED} values")
    counts = durable(signature_counts(rows, load, columns, others, lists))
    found = _candidates(counts, lists, least_gain)
    common = _common_runs(rows, columns, others, found)
    alternatives: dict[str, dict[tuple, tuple[Alternative, float, float]]] = {}
    for r in found:
        per_row, share = r["chars"] / r["n"], 1.0
        if r["kind"] == "list":
            alternative, bits = Alternative(r["key"], True, r["n"]), _list_bits(lists[r["key"]])
        else:
            loose, bits, literal = r["kind"] == "loose", 0.0, {}
            for i, (kind, _, length) in enumerate(_runs(r["key"])):
                if kind not in _CLASSES:
                    continue
                text, n, mean = common.get((r["field_name"], r["kind"], r["key"], i), ("", 0, 1.0))
                opened = mean * _CLASSES[kind][1] + 2 * math.log2(mean + 1) + 1 if loose else length * _CLASSES[kind][1]
                # Literal where writing out the rows that have something else costs less than leaving the run open.
                if text and max(0.0, 1 - n / r["n"]) * 8 * per_row < opened:
                    literal[i] = text
                    share *= min(1.0, n / r["n"])
                else:
                    bits += opened
            alternative = Alternative(_regex(r["key"], loose, literal), False, r["n"])
        alternatives.setdefault(r["field_name"], {})[r["kind"], r["key"]] = (alternative, bits, share)
    if not alternatives:
        return {}
    keys = {k: [r["key"] for r in found if r["kind"] == k] for k in ("list", "fixed", "loose")}
    kept = lambda c, kind: F.when(c.isin(keys[kind]), c) if keys[kind] else F.lit(None).cast("string")
    combined = counts.groupBy("load", "field_name", kept(F.col("listed"), "list").alias("list"), kept(F.col("sig"), "fixed").alias("fixed"), kept(_loose(F.col("sig")), "loose").alias("loose")).agg(F.sum("n").alias("n"), F.sum(8 * F.length("sig") * F.col("n")).alias("bits"))
    cells: dict[str, list] = {}
    for r in combined.collect():  # for each load what the few alternatives have in common, and the rest
        cells.setdefault(r["field_name"], []).append(r)
    return {f: _chosen(alternatives[f], cells[f], least_gain) for f in columns if f in alternatives}


def _chosen(alternatives: Mapping[tuple, tuple[Alternative, float, float]], cells: list, least_gain: float) -> list[Alternative]:
    """The alternatives that enter. alternatives: by kind and key, with the bits of a row and the share of its class that has the literal runs."""
    whole: dict = {}
    left = [r.asDict() for r in cells]
    for r in left:
        whole[r["load"]] = whole.get(r["load"], 0) + r["bits"]
    chosen: list[Alternative] = []
    while True:
        best, best_gain = None, 0.0
        naming = math.log2(len(chosen) + 2)
        for key, (alternative, bits, share) in sorted(alternatives.items()):
            if alternative in chosen:
                continue
            saved: dict = {}
            for r in left:
                if r[key[0]] == key[1]:
                    saved[r["load"]] = saved.get(r["load"], 0.0) + share * (r["bits"] - (bits + naming) * r["n"])
            gain = sum(saved.values()) - 8 * len(alternative.text)
            if gain > best_gain and 2 * sum(s >= least_gain * whole[at] for at, s in saved.items()) > len(whole):
                best, best_gain = key, gain
        if best is None:
            return chosen
        alternative, _, share = alternatives[best]
        chosen.append(alternative)
        for r in left:
            if r[best[0]] == best[1]:
                r["bits"], r["n"] = r["bits"] * (1 - share), r["n"] * (1 - share)


def readable(alternative: Alternative, others: Sequence[str]) -> str:
    """The alternative with its placeholders by name."""
    if alternative.is_list:
        return "{" + alternative.text + "}"
    out = alternative.text
    for i, name in enumerate(others):
        out = out.replace(_mark(i), "{" + name + "}")
    return out


def conforming(columns: Sequence[str], expressions: Expressions, others: Mapping[str, Column] | None = None, lists: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """For each column: does its value match its expression as a whole? False without an expression; never null."""
    out = {}
    for c, (v, t) in _fields(columns, others or {}).items():
        ok, texts = F.lit(False), [a.text for a in expressions.get(c, ()) if not a.is_list]
        for a in expressions.get(c, ()):
            if a.is_list:
                ok = ok | v.isin(list((lists or {})[a.text]))
        if texts:
            refers = any(_mark(i) in x for x in texts for i in range(len(others or {})))
            ok = ok | (t if refers else v).rlike("^(?:" + "|".join(texts) + r")\z")
        out[c] = F.coalesce(ok, F.lit(False))
    return out


def checked(rows: DataFrame, ids: Sequence[str], columns: Sequence[str], fits: Mapping[str, Column]) -> DataFrame:
    """(ids..., field_name, h, bad) with one row for each row and column; h is a hash of the value, null for a blank."""
    cell = lambda c: F.struct(F.lit(c).alias("field_name"), F.when(~is_blank(F.col(c).cast("string")), F.xxhash64(c)).alias("h"), (~is_blank(F.col(c).cast("string")) & ~fits[c]).alias("bad"))
    return rows.select(*ids, F.explode(F.array(*[cell(c) for c in columns])).alias("_x")).select(*ids, "_x.*")


def load_shares(cells: DataFrame, load: str) -> DataFrame:
    """(load, field_name, n_rows, n_blank, n_bad): the coverage of the expressions and the blanks of each load."""
    return cells.groupBy(load, "field_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("h").isNull()).alias("n_blank"), F.count_if("bad").alias("n_bad"))


def _heavy_values(rows: DataFrame, load: str, columns: Sequence[str], step: float) -> DataFrame:
    """(field_name, h) of each value that may hold more than `step` of some load: sketches of a load find all that do, and at most 1 / step a field beside those near it."""
    hashed = rows.select(load, *[F.when(~is_blank(F.col(c).cast("string")), F.xxhash64(c)).alias(f"h{i}") for i, c in enumerate(columns)])
    k = math.ceil(2 / step)
    tops = hashed.groupBy(load).agg(F.count("*").alias("n"), *[F.expr(f"approx_top_k(h{i}, {k}, 1000)").alias(f"t{i}") for i in range(len(columns))])
    each = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"t{i}").alias("top")) for i, c in enumerate(columns)])
    named = tops.select("n", F.explode(each).alias("x")).select("n", "x.field_name", F.explode("x.top").alias("e"))
    return named.filter((F.col("e.count") > (step - 0.01) * F.col("n")) & F.col("e.item").isNotNull()).select("field_name", F.col("e.item").alias("h")).distinct()


def deviating_loads(rows: DataFrame, cells: DataFrame, load: str, columns: Sequence[str], step: float = SHARE_STEP) -> DataFrame:
    """(load, field_name, measure, share, usual) where the share of blanks, of rows that break the expression or of one value differs from its median over all loads by more than `step`.

    A load without the value has share 0. A share that is at most `step` in every load can't differ by more, so only the
    values above it in some load, fewer than 1 / step a load and field, are counted.
    """
    sizes = durable(load_shares(cells, load))  # one row a load and field
    m = lambda name, c: F.struct(F.lit(name).alias("measure"), F.col(c).alias("n"))
    whole = sizes.select(load, "field_name", "n_rows", F.explode(F.array(m("blank", "n_blank"), m("broken", "n_bad"))).alias("m")).select(load, "field_name", "n_rows", "m.*")
    heavy = durable(_heavy_values(rows, load, columns, step))  # fewer than 1 / step a load and field
    one = cells.join(heavy, ["field_name", "h"]).groupBy(load, "field_name", "h").agg(F.count("*").alias("n"))
    every = sizes.select(load, "field_name", "n_rows").join(heavy, "field_name").join(one, [load, "field_name", "h"], "left")
    every = every.select(load, "field_name", "n_rows", F.concat(F.lit("value "), F.col("h").cast("string")).alias("measure"), F.coalesce("n", F.lit(0)).alias("n"))
    shares = whole.unionByName(every).withColumn("share", F.col("n") / F.col("n_rows"))
    median = shares.groupBy("field_name", "measure").agg(F.median("share").alias("usual"))
    return shares.join(median, ["field_name", "measure"]).filter(F.abs(F.col("share") - F.col("usual")) > step + 1e-12).select(load, "field_name", "measure", "share", "usual")


CASE_COLUMNS = ("transaction_type", "emb_id", "attachment_ref")


def registry_terms(registry: DataFrame, transaction_types: DataFrame) -> tuple[dict[str, Column], dict[str, list[str]]]:
    """What a pattern of the registry may refer to, and its reference list: a short fixed table."""
    types = [r[0] for r in transaction_types.select("type_name").distinct().limit(MOST_LISTED + 1).collect()]
    return {"iis_no": canonical_no(F.col("iis_no"))}, {"transaction_types": types}


def registry_expressions(registry: DataFrame, transaction_types: DataFrame, columns: Sequence[str] = CASE_COLUMNS) -> dict[str, list[Alternative]]:
    """The induced expressions of the registry's columns: a pattern may refer to the row's document number, a column to the list of types."""
    others, lists = registry_terms(registry, transaction_types)
    return induce_expressions(registry, "load_no", columns, others, lists)


def registry_cases(registry: DataFrame, transaction_types: DataFrame, expressions: Expressions | None = None) -> DataFrame:
    """(load_no, field_name, row_no): rows whose value breaks the column's induced expression, and, with row_no 0, loads that differ from the others.

    Values count as stored. Null, empty and space-only values are blank and never break anything. A row without a document
    number can't match a pattern that refers to it. Empty input gives no rows; further columns are ignored.
    """
    others, lists = registry_terms(registry, transaction_types)
    found = induce_expressions(registry, "load_no", CASE_COLUMNS, others, lists) if expressions is None else expressions
    fits = conforming(CASE_COLUMNS, found, others, lists)
    cells = checked(registry, ["load_no", "row_no"], CASE_COLUMNS, fits)
    rows = cells.filter("bad").select("load_no", "field_name", "row_no").distinct()
    loads = deviating_loads(registry, cells, "load_no", CASE_COLUMNS).select("load_no", "field_name", F.lit(0).alias("row_no")).distinct()
    return rows.unionByName(loads)


def coverage(rows: DataFrame, load: str, columns: Sequence[str], expressions: Expressions, others: Mapping[str, Column] | None = None, lists: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(load, field_name, expression, n_filled, n_fit, coverage, usual, differs): what each load's values have of the expression, against the median of all loads.

    coverage is the share of all rows that don't break the expression, as the cases count it.
    """
    sizes = load_shares(checked(rows, [load], columns, conforming(columns, expressions, others, lists)), load)
    sizes = sizes.withColumn("coverage", F.round(1 - F.col("n_bad") / F.col("n_rows"), 6))
    median = sizes.groupBy("field_name").agg(F.round(F.median("coverage"), 6).alias("usual"))
    named = F.lit(None).cast("string")
    for c in columns:
        if expressions.get(c):
            named = F.when(F.col("field_name") == c, F.lit(" | ".join(readable(a, list(others or {})) for a in expressions[c]))).otherwise(named)
    n_filled = F.col("n_rows") - F.col("n_blank")
    return sizes.join(median, "field_name").select(
        load, "field_name", named.alias("expression"), n_filled.alias("n_filled"), (n_filled - F.col("n_bad")).alias("n_fit"), "coverage", "usual", (F.abs(F.col("coverage") - F.col("usual")) > SHARE_STEP).alias("differs")
    )


def profile(rows: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """Per load and column: rows, nulls, blanks, distinct values (by a 64-bit hash), least and greatest value as text, and lengths.

    Hashes of values are counted by (load, column, hash); the rest are plain aggregates of each task.
    """
    text = {c: F.when(~is_blank(F.col(c).cast("string")), F.col(c).cast("string")) for c in columns}
    cell = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(text[c]).alias("h")) for i, c in enumerate(columns)])
    none = F.xxhash64(F.lit(None).cast("string"))
    distinct = rows.select(load, F.explode(cell).alias("x")).select(load, "x.*").filter(F.col("h") != none).groupBy(load, "i", "h").agg(F.lit(1)).groupBy(load, "i").agg(F.count("*").alias("n_values"))
    wide = rows.groupBy(load).agg(F.count("*").alias("n_rows"), *[
        a.alias(f"{n}{i}") for i, c in enumerate(columns)
        for n, a in (("null", F.count_if(F.col(c).isNull())), ("filled", F.count(text[c])), ("least", F.min(text[c])), ("greatest", F.max(text[c])), ("shortest", F.min(F.length(text[c]))), ("longest", F.max(F.length(text[c]))))
    ])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("field_name"), F.col(f"null{i}").alias("n_null"), (F.col("n_rows") - F.col(f"filled{i}")).alias("n_blank"), *[F.col(f"{n}{i}").alias(n) for n in ("least", "greatest", "shortest", "longest")]) for i, c in enumerate(columns)])
    tall = wide.select(load, "n_rows", F.explode(each).alias("x")).select(load, "n_rows", "x.*")
    return tall.join(distinct, [load, "i"], "left").select(load, "field_name", "n_rows", "n_null", "n_blank", F.coalesce("n_values", F.lit(0)).alias("n_values"), "least", "greatest", "shortest", "longest")
