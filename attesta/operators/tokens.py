"""Typed tokens of a page (E1-E10), the comparison of two readings of it (J4-J7, E11) and what both rest on (A4, A5).

Extraction is one Arrow function over whole texts: a page is a list of lines, each with the spans that earlier classes have
claimed. Finders run in the order of CLASSES and see a line with its claimed spans blanked, so that no later class matches
into or across them. Matching of tokens is relational where it can be (multiset match, numbered outer join); the nearest
match is greedy, so it stays inside one page pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attesta.functions import text as t
from attesta.sources.spread import spread

# The shapes of the token classes, the thresholds and the strict classes.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DIGIT = "0-9OoQDlI|SBZG"
REF = DIGIT + "ti"
DASH = "[-\u2010-\u2015\u2212~=]"
TAIL = rf"(?:[{DIGIT}]{{0,2}}(?:[,.][{DIGIT}]{{3}})+|[{DIGIT}]*)(?:[,.][{DIGIT}]{{2}})?"
MONEY = re.compile(rf"(?:₱|[Pp][Hh][Pp])\s?[{DIGIT}]{TAIL}|(?<![A-Za-z0-9])[Pp]\s?[0-9]{TAIL}", re.A)
IN_PESOS = rf"\(\s*[^\d\s)₱Pp]?\s*([{DIGIT}]{TAIL})\s*\)"
PESOS = re.compile(rf"\bPESOS?\s*{IN_PESOS}", re.A | re.I)
SHAPES = {
    "date": re.compile(rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b|\b(?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}}\b", re.A | re.I),
    "duration": re.compile(r"\b\d+\s+(?:calendar\s+)?(?:day|days|month|months|year|years|week|weeks)\b", re.A | re.I),
    "reference": re.compile(rf"\bR[{REF}]{DASH}[{REF}]{{4}}{DASH}[{REF}]{{6}}\b|\bNo\.\s?[{REF}]{{2}}{DASH}[{REF}]{{3,6}}\b", re.A),
    "citation": re.compile(rf"\b(?:Section|Sec\.|Rule|Article|Art\.)\s+(?:[IVXLC]+|(?=[{DIGIT}]*[0-9|])[{DIGIT}]+)(?![A-Za-z0-9])", re.A | re.I),
    "name": re.compile(r"\b[A-Z][A-Z&.'-]+(?:\s+[A-Z][A-Z&.'-]+)+\b", re.A),
}
LIST_ITEM = re.compile(r"-\s+([A-Z0-9].*?)\s*\Z", re.A)
MARKER = re.compile(r"\b(\d{1,2})\.\s+", re.A)
FIELD = re.compile(r"^\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\s*[-_.\s]{0,10}:\s*(.+?)\s*\Z", re.A)
FIELD_NOISE = re.compile("[\\s:;+_.\u2010-\u2015\u2212-]*", re.A)
STRICT = ("money", "date", "duration", "reference", "citation", "field")
SAME_PAGE, LEAST_WORDS, TITLE_FLOOR = 0.4, 20, 0.7

_WS = re.compile(t.WS + "+", re.A)
_SEAL = re.compile(t.SEAL_LINE, re.A)
_BLANK = "\0"


def canonical(s: str) -> str:
    return _WS.sub(" ", s).strip(" ")


def without_seal(s: str | None) -> str:
    return canonical(_SEAL.sub(" ", s or ""))


@dataclass
class Token:
    cls: str
    value: str
    line: int
    label: str | None = None
    number: str | None = None


@dataclass
class Page:
    """Lines without seal lines, and what is claimed of each."""

    lines: list[str]
    taken: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str | None) -> "Page":
        lines = [without_seal(x) for x in (text or "").split("\n")]
        return cls(lines, [[] for _ in lines])

    def open(self, i: int) -> str:
        """Line i with its claimed spans blanked."""
        s = self.lines[i]
        for a, b in self.taken[i]:
            s = s[:a] + _BLANK * (b - a) + s[b:]
        return s


Found = Iterator[tuple[int, int, int, Token]]  # line index, span to claim, token


def list_items(page: Page) -> Found:
    """A hyphen bullet beside a line with another one."""
    hits = [LIST_ITEM.search(x) for x in page.lines]
    for i, m in enumerate(hits):
        if m and any(hits[j] for j in (i - 1, i + 1) if 0 <= j < len(hits)):
            yield i, 0, len(page.lines[i]), Token("listItem", m[1], i + 1)


def numbered_items(page: Page) -> Found:
    """E2: 'n. text' up to the next marker, where something shows that the item ends: a marker, a later number below, the last line."""
    marks = [list(MARKER.finditer(x)) for x in page.lines]
    for i, here in enumerate(marks):
        below = [int(m[1]) for m in marks[i + 1]] if i + 1 < len(marks) else None
        for m, following in zip(here, [*here[1:], None]):
            end = following.start() if following else len(page.lines[i])
            bounded = following or below is None or any(n > int(m[1]) for n in below)
            value = page.lines[i][m.end() : end].strip()
            if bounded and value:
                yield i, m.start(), end, Token("numberedItem", value, i + 1, number=m[1])


def real(amount: str) -> bool:
    return any(c in "0123456789,." for c in amount)


def _is_amount(s: str, m: re.Match) -> bool:
    """A peso sign before lookalikes needs a digit or separator; a bare P must be no page mark and no part of a word."""
    if not real(m[0]):
        return False
    if m[0][0] == "₱" or m[0][:3].lower() == "php":
        return True
    rest = s[m.end() :]
    if re.match(r"/[0-9]", rest):
        return False
    glued = re.match("[A-Za-z]", rest)
    return not glued or "," in m[0] or "." in m[0] or bool(re.fullmatch(r"[1-9][0-9]+", re.sub(r"^[Pp]\s?", "", m[0])))


def amounts(page: Page) -> Found:
    """Amounts with a sign; 'PESOS (amount)'; the same where the word breaks over two lines."""
    for i in range(len(page.lines)):
        s = page.open(i)
        for m in MONEY.finditer(s):
            if _is_amount(s, m):
                yield i, m.start(), m.end(), Token("money", m[0], i + 1)
        for m in PESOS.finditer(s):
            if real(m[1]):
                yield i, m.start(), m.end(), Token("money", "₱" + m[1], i + 1)
        if i:
            tail, head = re.search(r"([A-Za-z]{1,4})-\s*\Z", page.open(i - 1)), re.match(r"\s*([A-Za-z]{1,4})\b", s, re.A)
            if tail and head and (tail[1] + head[1]).upper() in ("PESO", "PESOS"):
                m = re.match(r"\s*" + IN_PESOS, s[head.end() :], re.A | re.I)
                if m and real(m[1]):
                    yield i, head.end(), head.end() + m.end(), Token("money", "₱" + m[1], i + 1)


def shaped(cls: str) -> Callable[[Page], Found]:
    """What has the shape of the class."""

    def find(page: Page) -> Found:
        for i in range(len(page.lines)):
            for m in SHAPES[cls].finditer(page.open(i)):
                if cls != "reference" or real(m[0]):
                    yield i, m.start(), m.end(), Token(cls, m[0], i + 1)

    return find


def fields(labels: Sequence[str] | None) -> Callable[[Page], Found]:
    """E9: 'Label : value' of the record; with `labels`, the first of them that stands on the line with a value after it."""

    def find(page: Page) -> Found:
        for i in range(len(page.lines)):
            s = page.open(i)
            if labels is None:
                m = FIELD.match(s)
                if m and _BLANK not in m[2]:
                    at = s.index(m[2])
                    yield i, at, at + len(m[2]), Token("field", m[2], i + 1, label=m[1])
                continue
            for label in labels:
                at = s.find(label)
                end = at + len(label)
                if at < 0 or re.search("[A-Za-z]{2,}", s[:at]) or re.match("[A-Za-z]", s[end:]):
                    continue
                begin = FIELD_NOISE.match(s, end).end()
                value = s[begin:].rstrip()
                if value and _BLANK not in value:
                    begin = s.index(value, end)
                    yield i, begin, begin + len(value), Token("field", value, i + 1, label=label)
                    break

    return find


def signatory_title(page: Page, names: Sequence[Token]) -> Token | None:
    """The lines under the last name, as far as they are free and hold words."""
    if not names:
        return None
    anchor = max(n.line for n in names)
    lines = []
    for i in range(anchor, len(page.lines)):
        s = page.lines[i]
        enough = 2 if re.search("[0-9]", s) else 1
        if page.taken[i] or not s or len(re.findall("[A-Za-z]{3,}", s)) < enough:
            break
        lines.append(s)
    return Token("signatoryTitle", " ".join(lines), anchor + 1) if lines else None


def field_labels(text: str | None) -> list[str]:
    """The labels of the record's fields, in order."""
    found = (FIELD.match(x) for x in Page.of(text).lines)
    return list(dict.fromkeys(m[1] for m in found if m))


def extract_tokens(text: str | None, labels: Sequence[str] | None = None) -> list[Token]:
    """All tokens of a page by line, then class, then place. A null text is an empty page."""
    page, out = Page.of(text), []
    for finder in (list_items, numbered_items, amounts, *map(shaped, SHAPES), fields(labels)):
        for i, a, b, token in finder(page):
            page.taken[i].append((a, b))
            out.append(token)
    title = signatory_title(page, [x for x in out if x.cls == "name"])
    return sorted(out + [title] * bool(title), key=lambda x: x.line)


# --- Python twins of the scalar functions, for use inside the Arrow functions ---

_FOLD = str.maketrans(*t.GLYPHS)
_PUNCT = str.maketrans(*t.PUNCT)


def word_list(text: str | None) -> list[str]:
    return [w for w in without_seal(text).translate(_PUNCT).lower().split(" ") if w]


def key_for(cls: str, value: str) -> str:
    s = canonical(value).translate(_FOLD).lower()
    if cls in t.NAME_LIKE:
        return s.replace("rn", "m").replace("cl", "d").replace("vv", "w")
    s = re.sub(r"^(?:php|p)\s?", "₱", s)
    if cls == "reference":
        return re.sub(DASH, "-", s)
    return re.sub(r",(?=\d{2}\Z)", ".", re.sub(r"[,.](?=\d{3}(?:\D|\Z))", "", s, flags=re.A), flags=re.A) if cls == "money" else s


def reason_for(expected: str, found: str) -> str:
    a, b = (re.sub("[^0-9]", "", x.translate(_FOLD)) for x in (expected, found))
    return "digit-count" if len(a) != len(b) else "digit-substitution" if a != b else "text"


def wrap_prefix(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    n = min(len(x), len(y))
    return x[:n] == y[:n]


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """A4: the longest common subsequence, one machine word operation for many cells: each word of `b` is one step on the bits of `a`."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similarity(a: Sequence[str], b: Sequence[str]) -> float:
    """A5: 1 for two empty pages."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


# --- comparison of one pair ---


def _finding(severity: str, cls: str, line: int | None, expected: str | None, found: str | None, reason: str) -> dict:
    return {"severity": severity, "cls": cls, "line": line, "expected": expected, "found": found, "reason": reason}


def nearest(record: Sequence[Token], photo: Sequence[Token], unmatched: Sequence[Token]) -> dict[int, Token]:
    """For each unmatched record token (by index in `unmatched`) the free photo token of its class that is nearest by line.

    Photo tokens whose key the record has anywhere are no candidates; fields must have the same label. In record order, each
    photo token once, the first of equals.
    """
    keys = {key_for(x.cls, x.value) for x in record}
    free = [x for x in photo if key_for(x.cls, x.value) not in keys]
    out: dict[int, Token] = {}
    for i, a in enumerate(unmatched):
        fit = [x for x in free if x.cls == a.cls and (a.cls != "field" or x.label == a.label)]
        if fit:
            out[i] = min(fit, key=lambda x: abs(x.line - a.line))
            free = [x for x in free if x is not out[i]]
    return out


def _surplus(tokens: Sequence[Token], against: Sequence[Token]) -> list[Token]:
    """The tokens that remain when each is paired with one of the same key, first with first. Keys alone count, not classes."""
    stock: dict[str, int] = {}
    for x in against:
        k = key_for(x.cls, x.value)
        stock[k] = stock.get(k, 0) + 1
    out = []
    for x in tokens:
        k = key_for(x.cls, x.value)
        if stock.get(k, 0):
            stock[k] -= 1
        else:
            out.append(x)
    return out


def _by_number(tokens: Sequence[Token]) -> dict[str, Token]:
    return {x.number: x for x in tokens if x.cls == "numberedItem"}


def _numbered(record: Sequence[Token], photo: Sequence[Token]) -> list[dict]:
    """Outer join of numbered items by number, the last of a number counting."""
    a, b, out = _by_number(record), _by_number(photo), []
    for n, x in a.items():
        y = b.get(n)
        if y is None:
            out.append(_finding("tolerant", "numberedItem", x.line, x.value, None, "missing"))
        elif not wrap_prefix(key_for(x.cls, x.value), key_for(y.cls, y.value)):
            out.append(_finding("material", "numberedItem", x.line, x.value, y.value, "text"))
    return out + [_finding("material", "numberedItem", None, None, y.value, "added") for n, y in b.items() if n not in a]


def _title(record: Sequence[Token], photo: Sequence[Token]) -> list[dict]:
    """Signatory titles are the same above TITLE_FLOOR."""
    a, b = (next((x for x in ts if x.cls == "signatoryTitle"), None) for ts in (record, photo))
    if a is None:
        return []
    if b is None:
        return [_finding("tolerant", a.cls, a.line, a.value, None, "missing")]
    alike = similarity(key_for(a.cls, a.value).split(" "), key_for(b.cls, b.value).split(" "))
    return [] if alike >= TITLE_FLOOR else [_finding("material", a.cls, a.line, a.value, b.value, "text")]


def compare_texts(photo_text: str | None, record_text: str | None) -> dict:
    """Status, similarity, findings (material first, by line) and the number of suppressed differences."""
    seen, known = word_list(photo_text), word_list(record_text)
    if len(seen) < LEAST_WORDS:
        return {"status": "image_unreadable", "similarity": 0.0, "findings": [], "suppressed": 0}
    common = lcs_length(seen, known)
    alike = 2 * common / (len(seen) + len(known))
    if alike < SAME_PAGE:
        return {"status": "page_differs", "similarity": alike, "findings": [], "suppressed": 0}
    return {"status": "compared", "similarity": alike} | _compared(photo_text, record_text, max(len(seen), len(known)) - common)


def _compared(photo_text: str | None, record_text: str | None, word_difference: int) -> dict:
    record, photo = extract_tokens(record_text), extract_tokens(photo_text, field_labels(record_text))
    out: list[dict] = []
    left = _surplus([x for x in record if x.cls not in ("numberedItem", "signatoryTitle")], photo)
    near = nearest(record, photo, left)
    for i, x in enumerate(left):
        y = near.get(i)
        if x.cls not in STRICT:
            if y is None or not wrap_prefix(key_for(x.cls, x.value), key_for(y.cls, y.value)):
                out.append(_finding("tolerant", x.cls, x.line, x.value, y and y.value, "text"))
        elif y is None:
            out.append(_finding("tolerant" if x.cls == "reference" else "material", x.cls, x.line, x.value, None, "missing"))
        else:
            out.append(_finding("material", x.cls, x.line, x.value, y.value, reason_for(x.value, y.value)))
    used = {id(y) for y in near.values()}
    evident = lambda x: x.cls != "citation" or _cited(x.value)
    fresh = [x for x in photo if x.cls in (*STRICT, "listItem") and id(x) not in used and evident(x)]
    out += [_finding("material", x.cls, None, None, x.value, "added") for x in _surplus(fresh, record)]
    out += _numbered(record, photo) + _title(record, photo)
    suppressed = sum(f["severity"] == "tolerant" for f in out) + max(0, word_difference - len(out))
    out.sort(key=lambda f: (f["severity"] == "tolerant", 1e9 if f["line"] is None else f["line"]))
    return {"findings": out, "suppressed": suppressed}


def _cited(value: str) -> bool:
    numeral = re.sub(r"^(?:Section|Sec\.|Rule|Article|Art\.)\s+", "", value, flags=re.A | re.I)
    return bool(re.fullmatch("[IVXLC]+", numeral, re.I) or re.search("[0-9]", numeral))


# --- DataFrame operators ---

FINDING = "struct<severity:string,cls:string,line:int,expected:string,found:string,reason:string>"


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _I = T.StringType(), T.IntegerType()
TOKENS = T.ArrayType(_struct(cls=_S, value=_S, line=_I, label=_S, number=_S))
FINDINGS = _struct(findings=T.ArrayType(_struct(severity=_S, cls=_S, line=_I, expected=_S, found=_S, reason=_S)), suppressed=_I)


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(TOKENS)
def tokens_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[vars(x) for x in extract_tokens(s)] for s in text])


@F.pandas_udf(TOKENS)
def photo_tokens_udf(text: pd.Series, record: pd.Series) -> pd.Series:
    return pd.Series([[vars(x) for x in extract_tokens(s, field_labels(r))] for s, r in zip(text, record)])


@F.pandas_udf(FINDINGS)
def findings_udf(photo: pd.Series, record: pd.Series, difference: pd.Series) -> pd.DataFrame:
    rows = [_compared(p, r, int(d)) if d >= 0 else {"findings": [], "suppressed": 0} for p, r, d in zip(photo, record, difference)]
    return pd.DataFrame({"findings": [r["findings"] for r in rows], "suppressed": [r["suppressed"] for r in rows]})


# A filter on what a function gives would else run it once more.
lcs_udf, tokens_udf, photo_tokens_udf, findings_udf = (f.asNondeterministic() for f in (lcs_udf, tokens_udf, photo_tokens_udf, findings_udf))


def page_tokens(pages: DataFrame, text: str = "text", record: str | None = None) -> DataFrame:
    """`pages` with one row for each token: seq, cls, value, line, label, number, match_key."""
    made = tokens_udf(F.col(text)) if record is None else photo_tokens_udf(F.col(text), F.col(record))
    rows = spread(pages).select(*[c for c in pages.columns if c not in (text, record)], F.posexplode(made).alias("seq", "tok"))
    return rows.select("*", "tok.*").drop("tok").withColumn("match_key", t.match_key(F.col("cls"), F.col("value")))


def plain_tokens(pages: DataFrame, cls: str, text: str = "text") -> DataFrame:
    """E4, E5 and E8 without claims, in Catalyst alone: (..., line, value) of one class of SHAPES."""
    w = "[A-Za-z0-9_]"
    boundary = f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    pattern = SHAPES[cls].pattern.replace(r"\b", boundary)
    flags = "(?i)" if SHAPES[cls].flags & re.I else ""
    rest = [c for c in pages.columns if c != text]
    lines = pages.select(*rest, F.posexplode(F.split(t.text(F.col(text)), "\n")).alias("pos", "raw"))
    found = lines.select(*rest, (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all(t.strip_seal_lines(F.col("raw")), F.lit(f"{flags}({pattern})"), 1)).alias("value"))
    return found


def multiset_surplus(tokens: DataFrame, against: DataFrame, pair: Sequence[str]) -> DataFrame:
    """The rows of `tokens` (pair, match_key, seq) beyond the number that `against` has of their pair and key; the later ones remain."""
    stock = against.groupBy(*pair, "match_key").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*pair, "match_key").orderBy("seq")
    ranked = tokens.withColumn("_rn", F.row_number().over(w)).join(stock, [*pair, "match_key"], "left")
    return ranked.filter(F.col("_rn") > F.coalesce("_n", F.lit(0))).drop("_rn", "_n")


def numbered_join(record: DataFrame, photo: DataFrame, pair: str) -> DataFrame:
    """Findings from (pair, seq, number, value, line) on both sides; the last item of a number counts."""
    last = lambda df, s: df.groupBy(pair, "number").agg(F.max_by(F.struct("value", "line"), "seq").alias(s))
    j = last(record, "a").join(last(photo, "b"), [pair, "number"], "full_outer")
    key = lambda c: t.match_key(F.lit("numberedItem"), c)
    same = F.coalesce(t.is_wrap_prefix(key(F.col("a.value")), key(F.col("b.value"))), F.lit(False))
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(~same, "text")
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select(pair, "number", F.when(F.col("reason") == "missing", "tolerant").otherwise("material").alias("severity"), F.col("a.line").alias("line"), F.col("a.value").alias("expected"), F.col("b.value").alias("found"), "reason")


_ROW = _struct(side=_I, seq=_I, cls=_S, value=_S, line=_I, label=_S)
_NEAR = T.ArrayType(_struct(seq=_I, found_seq=_I))


@F.pandas_udf(_NEAR)
def nearest_udf(rows: pd.Series) -> pd.Series:
    out = []
    for page in rows:
        sides: list[list[Token]] = [[], [], []]
        seqs: list[list[int]] = [[], [], []]
        for r in page:
            sides[r["side"]].append(Token(r["cls"], r["value"], int(r["line"]), r["label"]))
            seqs[r["side"]].append(int(r["seq"]))
        place = {id(x): q for x, q in zip(sides[2], seqs[2])}
        out.append([{"seq": seqs[0][i], "found_seq": place[id(y)]} for i, y in nearest(sides[1], sides[2], sides[0]).items()])
    return pd.Series(out)


def nearest_tokens(unmatched: DataFrame, record: DataFrame, photo: DataFrame, pair: str) -> DataFrame:
    """(pair, seq, found_seq) for token rows of pages. The tokens of one page pair are one array, which a page bounds."""
    side = lambda df, s: df.select(pair, F.struct(*[(F.lit(s) if f.name == "side" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in _ROW.fields]).alias("r"))
    rows = side(unmatched, 0).unionByName(side(record, 1)).unionByName(side(photo, 2))
    pages = rows.groupBy(pair).agg(F.array_sort(F.collect_list("r")).alias("rows"), F.min("r.side").alias("_least")).filter("_least = 0")
    return pages.select(pair, F.explode(nearest_udf("rows")).alias("n")).select(pair, "n.*")


def compare_pages(pairs: DataFrame) -> DataFrame:
    """E11 over (pair_id, ocr_text, auth_text): pair_id, status, similarity, findings, suppressed.

    Words and their common subsequence come first; only pairs that read as the same page reach the extraction of tokens.
    Null texts are empty: such pairs are 'image_unreadable'.
    """
    w = spread(pairs.select("pair_id", "ocr_text", "auth_text")).withColumn("_a", t.words(F.col("ocr_text"))).withColumn("_b", t.words(F.col("auth_text")))
    w = w.withColumn("_n", F.size("_a")).withColumn("_m", F.size("_b"))
    read = F.col("_n") >= LEAST_WORDS
    # Unread pages go through the first function with nothing to compare, other pages through the second.
    w = w.withColumn("_l", lcs_udf(F.when(read, F.col("_a")), F.col("_b"))).drop("_a", "_b").withColumn("similarity", F.when(read, 2.0 * F.col("_l") / (F.col("_n") + F.col("_m"))).otherwise(0.0))
    w = w.withColumn("status", F.when(~read, "image_unreadable").when(F.col("similarity") < SAME_PAGE, "page_differs").otherwise("compared"))
    w = w.withColumn("r", findings_udf("ocr_text", "auth_text", F.when(F.col("status") == "compared", F.greatest("_n", "_m") - F.col("_l")).otherwise(-1)))
    return w.select("pair_id", "status", "similarity", "r.findings", "r.suppressed")


def shown_findings(compared: DataFrame) -> DataFrame:
    """One row for each finding that is shown (the material ones), in words."""
    f = compared.select("pair_id", F.posexplode("findings").alias("seq", "f")).filter("f.severity = 'material'")
    words = F.when(F.col("f.expected").isNull(), F.concat(F.lit("Added: "), F.col("f.found"))).when(F.col("f.found").isNull(), F.concat(F.lit("Missing: "), F.col("f.expected"))).otherwise(F.concat(F.lit("Reads "), F.col("f.found"), F.lit(" for "), F.col("f.expected")))
    return f.select("pair_id", "seq", "f.cls", words.alias("finding"))


def similarity_columns(a: Column, b: Column) -> Column:
    """A5 over two arrays of words."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * lcs_udf(a, b) / n)
