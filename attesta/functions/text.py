"""Scalar text functions: normalising identifiers, parsing seal lines, folding recognised text. All are Catalyst expressions.

Patterns follow the semantics of browser regular expressions: white space is the Unicode set in WS, word boundaries are
ASCII. Every function takes and returns Columns; null input counts as the empty string unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The white space that collapses, the printed seal line, and what recognition confuses.
WS = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
SEAL_LINE = rf"EMB{WS}*·{WS}*([A-Z0-9-]+){WS}*·{WS}*p([0-9]+)/([0-9]+){WS}*·{WS}*K([0-9A-Za-z]+){WS}*·{WS}*([0-9A-Z]{{4}}-[0-9A-Z]{{4}})"
DOCUMENT_NO = rf"(?i){LEFT}(?:EMB)?(R1)-((?:19|20)[0-9][0-9])-([0-9]{{4,}}){RIGHT}"
GLYPHS = ("OoQDlI|tiSBZG", "0000111115826")
PUNCT = ("\u2018\u2019\u201b\u201c\u201d\u201f\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "'''" + '"""' + "-------")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use(c)` with `c` computed once, however often `use` names it; it also keeps plans small where functions nest."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(text(c), rf"^{WS}+|{WS}+\z", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_id(payload: Column) -> Column:
    """STRUCT(raw, kind, canonical_id, lookup_key); kind is 'iis_no', 'token' or 'unknown'."""
    s = js_trim(payload)
    is_url = s.rlike("(?i)^https?://")
    segments = F.filter(F.split(F.regexp_replace(F.regexp_replace(s, r"(?s)\?.*", ""), "(?s)#.*", ""), "/"), lambda x: x != "")
    tail = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    candidate = F.when(is_url & ~s.rlike(DOCUMENT_NO), tail).otherwise(s)
    number = F.concat_ws("-", F.upper(F.regexp_extract(candidate, DOCUMENT_NO, 1)), F.regexp_extract(candidate, DOCUMENT_NO, 2), F.regexp_extract(candidate, DOCUMENT_NO, 3))
    is_no = candidate.rlike(DOCUMENT_NO)
    is_token = (F.length(candidate) >= 12) & candidate.rlike("(?i)[a-f0-9]{8,}")
    kind = F.when(is_no, "iis_no").when(is_token, "token").otherwise("unknown")
    canonical = F.when(is_no, number).when(is_token, candidate).otherwise(js_trim(candidate))
    return F.struct(text(payload).alias("raw"), kind.alias("kind"), canonical.alias("canonical_id"), canonical.alias("lookup_key"))


def live_record_no(page: Column, kind: Column, canonical: Column) -> Column:
    """The number of a live page, null where it says that there is no record."""
    found = null_if_empty(F.regexp_extract(text(page), "R1-(?:19|20)[0-9][0-9]-[0-9]{4,}", 0))
    none = (text(page) == "") | text(page).rlike(rf"(?i)no{WS}+record|not{WS}+found")
    return F.when(~none, F.when(kind == "iis_no", canonical).otherwise(F.coalesce(found, canonical)))


def lookup_url(kind: Column, canonical: Column, base: Column, view: str = "/view/", search: str = "/search?q=") -> Column:
    """Where a number (under the path `search`) or a token (under `view`) is looked up; the query is percent-encoded as encodeURIComponent does."""
    q = F.url_encode(canonical)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        q = F.replace(q, F.lit(encoded), F.lit(plain))
    return F.when(kind == "token", F.concat(base, F.lit(view), canonical)).otherwise(F.concat(base, F.lit(search), q))


def label_value(page: Column, label: str) -> Column:
    """The value of a 'Label : value' line; null where there is none."""
    return null_if_empty(js_trim(F.regexp_extract(text(page), rf"(?im)^{WS}*{label}{WS}*:{WS}*(.+?){WS}*$", 1)))


def parse_verification_page(page: Column) -> Column:
    """P5: STRUCT(iis_no, subject, status, division, company_name), null without a number that can be sealed."""
    no = label_value(page, rf"IIS{WS}*No\.?")
    row = F.struct(no.alias("iis_no"), label_value(page, "Subject").alias("subject"), label_value(page, "Status").alias("status"), label_value(page, "Division").alias("division"), label_value(page, rf"Company{WS}*Name").alias("company_name"))
    return F.when(F.coalesce(no.rlike(r"^R1-(?:20|21)[0-9][0-9]-[0-9]{6}\z"), F.lit(False)), row)


def may_fetch(url: Column, base: Column) -> Column:
    """May a URL from an uploaded document be followed? Only to the host of `base`, over http, without credentials."""
    part = lambda u, p: F.try_parse_url(u, F.lit(p))
    ok = F.lower(part(url, "PROTOCOL")).isin("http", "https") & part(url, "USERINFO").isNull() & (F.lower(part(url, "HOST")) == F.lower(part(base, "HOST")))
    return F.coalesce(ok, F.lit(False))


def canonicalize(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{WS}+", " "))


def strip_seal_lines(c: Column) -> Column:
    """All printed seal lines removed, then P7."""
    return canonicalize(F.regexp_replace(text(c), SEAL_LINE.replace("(", "(?:"), " "))


def parse_seal_line(c: Column) -> Column:
    """STRUCT(iis_no, k, n, kid, seal) of the first seal line, or null."""
    def parts(s: Column) -> Column:
        g = lambda i: F.regexp_extract(s, SEAL_LINE, i)
        number = lambda i: g(i).try_cast("int")
        return F.when(s != "", F.struct(g(1).alias("iis_no"), number(2).alias("k"), number(3).alias("n"), g(4).alias("kid"), g(5).alias("seal")))

    return once(F.regexp_extract(text(c), SEAL_LINE, 0), parts)


PAYLOAD = r"(?i)^CVR\|([^|]+)\|([0-9]+)\|([0-9A-Za-z-]+)"


def parse_payload(c: Column) -> Column:
    """P10: STRUCT(iis_no, k, seal) of 'CVR|number|page|seal', or null."""
    g = lambda i: F.regexp_extract(text(c), PAYLOAD, i)
    return F.when(text(c).rlike(PAYLOAD), F.struct(F.upper(g(1)).alias("iis_no"), g(2).cast("int").alias("k"), F.upper(g(3)).alias("seal")))


def seal_line(no: Column, k: Column, n: Column, kid: Column, seal: Column) -> Column:
    """The line as it is printed."""
    return F.concat_ws(" · ", F.lit("EMB"), no, F.concat(F.lit("p"), k.cast("string"), F.lit("/"), n.cast("string")), F.concat(F.lit("K"), kid), seal)


def payload(no: Column, k: Column, seal: Column) -> Column:
    """What the mark carries."""
    return F.concat_ws("|", F.lit("CVR"), no, k.cast("string"), seal)


def parse_loose_line(c: Column) -> Column:
    """STRUCT(iis_no, k, seal) of a pasted line, or null; the last seal-shaped group counts, k may be ''."""
    raw = text(c)
    up = F.upper(raw)
    no = F.regexp_extract(up, "R1-(?:19|20)[0-9][0-9]-[0-9]{3,}", 0)
    seals = F.regexp_extract_all(up, F.lit("([A-Z2-7]{4}-[A-Z2-7]{4})"), 1)
    clear = raw.rlike(rf"(?i)·|EMB{RIGHT}|p{WS}*[0-9]+{WS}*/")
    return F.when(clear & (no != "") & (F.size(seals) > 0), F.struct(no.alias("iis_no"), F.regexp_extract(up, rf"P{WS}*([0-9]+){WS}*/", 1).alias("k"), F.try_element_at(seals, F.lit(-1)).alias("seal")))


def canonical_doc(c: Column) -> Column:
    """A typed number."""
    return F.regexp_replace(F.upper(js_trim(c)), "^EMB(?=R1-)", "")


def canonical_seal(c: Column) -> Column:
    """A typed seal."""
    t = F.regexp_replace(F.upper(js_trim(c)), "[^0-9A-Z]", "")
    return F.when(F.length(t) == 8, F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 4))).otherwise(t)


def dispatch_scan(c: Column) -> Column:
    """What a scan stands for: payload first, then a seal line; STRUCT(iis_no, k, seal), null for 'invalid_code'."""
    a, b = parse_payload(c), parse_loose_line(c)
    row = F.coalesce(F.when(a.isNotNull(), F.struct(a["iis_no"].alias("iis_no"), a["k"].cast("string").alias("k"), a["seal"].alias("seal"))), b)
    return F.when((row["iis_no"] != "") & (row["k"] != "") & (row["seal"] != ""), F.struct(row["iis_no"].alias("iis_no"), row["k"].alias("k"), canonical_seal(row["seal"]).alias("seal")))


def fold_glyphs(c: Column) -> Column:
    """Letters that recognition returns for digits."""
    return F.translate(text(c), *GLYPHS)


def fold_punctuation(c: Column) -> Column:
    """Curly quotes and dashes."""
    return F.translate(text(c), *PUNCT)


def words(c: Column) -> Column:
    """The words of a page, without seal lines, in lower case."""
    return F.filter(F.split(F.lower(fold_punctuation(strip_seal_lines(c))), " "), lambda w: w != "")


def fold_letters(c: Column) -> Column:
    """Letter runs that look like one letter."""
    return F.replace(F.replace(F.replace(c, F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")), F.lit("vv"), F.lit("w"))


NAME_LIKE = ("name", "field", "listItem", "numberedItem", "signatoryTitle")


def match_key(cls: Column, value: Column) -> Column:
    """The key under which two readings of a value are the same."""
    folded = F.lower(fold_glyphs(canonicalize(value)))
    key = F.regexp_replace(folded, r"^(?:php|p)\s?", "₱")
    money = F.regexp_replace(F.regexp_replace(key, r"[,.](?=[0-9]{3}(?:[^0-9]|\z))", ""), r",(?=[0-9]{2}\z)", ".")
    return F.when(cls.isin(*NAME_LIKE), fold_letters(folded)).when(cls == "reference", F.regexp_replace(key, r"[-\u2010-\u2015\u2212~=]", "-")).when(cls == "money", money).otherwise(key)


def digits(c: Column) -> Column:
    """P19."""
    return F.regexp_replace(text(c), "[^0-9]", "")


def difference_reason(expected: Column, found: Column) -> Column:
    """P20: 'digit-count', 'digit-substitution' or 'text'."""
    a, b = digits(fold_glyphs(expected)), digits(fold_glyphs(found))
    return F.when(F.length(a) != F.length(b), "digit-count").when(a != b, "digit-substitution").otherwise("text")


def is_wrap_prefix(a: Column, b: Column) -> Column:
    """One key is the other with more words at its end."""
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n)


def citation_has_evidence(c: Column) -> Column:
    """A Roman numeral alone, or a real digit."""
    numeral = F.regexp_replace(text(c), rf"(?i)^(?:Section|Sec\.|Rule|Article|Art\.){WS}+", "")
    return numeral.rlike(r"(?i)^[IVXLC]+\z") | numeral.rlike("[0-9]")


def amount_has_evidence(c: Column) -> Column:
    """P23."""
    return text(c).rlike("[0-9,.]")


def glued_reads_as_amount(c: Column) -> Column:
    """P24."""
    return text(c).rlike("[,.]") | F.regexp_replace(text(c), rf"^[Pp]{WS}?", "").rlike(r"^[1-9][0-9]+\z")


def safe_name(c: Column) -> Column:
    """P25: a name for a file."""
    return F.regexp_replace(text(c), "[^A-Za-z0-9_-]", "_")


def candidate_evidence(pages: Column, labelled: Column) -> Column:
    """How a number was found, in words."""
    n = F.size(pages)
    where = F.when(n == 1, F.concat(F.lit("page "), pages[0].cast("string"))).when(n == 2, F.concat(F.lit("pages "), pages[0].cast("string"), F.lit(" and "), F.try_element_at(pages, F.lit(2)).cast("string"))).otherwise(F.concat(F.lit("all "), n.cast("string"), F.lit(" pages")))
    return F.concat(F.lit("Found on "), where, F.lit(", "), F.when(labelled, "labelled “Control No.”").otherwise("unlabelled"), F.lit("."))
