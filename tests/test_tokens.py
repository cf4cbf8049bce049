"""Golden cases of tokens and comparison, and twins of the fast forms."""

import random

from attesta.operators import tokens as k


def values(text, cls, labels=None):
    return [x.value for x in k.extract_tokens(text, labels) if x.cls == cls]


def test_keys_fold_what_recognition_confuses():
    assert k.key_for("money", "₱5O,OOO.00") == k.key_for("money", "PHP 50,000.00")
    assert k.key_for("money", "P1,234,50") == "₱1234.50"
    assert k.key_for("name", "CORN") == k.key_for("name", "COM")


def test_money_shapes():
    assert values("Pay ₱5,000.00 now", "money") == ["₱5,000.00"]
    assert values("page p2/2 of it", "money") == []
    assert values("P500 fee", "money") == ["P500"]
    assert values("PESOS (5,000.00) only", "money") == ["₱5,000.00"]
    assert values("of PE-\nSOS (5,000.00) only", "money") == ["₱5,000.00"]
    assert values("₱OO", "money") == []


def test_dates_durations_references_citations():
    s = "on 2026-01-02 within 15 calendar days, R1-2026-000123, Section IV and Rule 12"
    assert (values(s, "date"), values(s, "duration"), values(s, "reference"), values(s, "citation")) == (["2026-01-02"], ["15 calendar days"], ["R1-2026-000123"], ["Section IV", "Rule 12"])


def test_list_and_numbered_items():
    assert values("- First\n- Second\nx", "listItem") == ["First", "Second"]
    assert values("- Alone\nx", "listItem") == []
    items = [(x.number, x.value) for x in k.extract_tokens("8. Keep it 18. Drop\n9. Return\nend") if x.cls == "numberedItem"]
    assert ("8", "Keep it") in items and ("18", "Drop") not in items


def test_fields_and_titles():
    assert [(x.label, x.value) for x in k.extract_tokens("Subject : Ana Cruz") if x.cls == "field"] == [("Subject", "Ana Cruz")]
    assert values("+ Subject ;; Ana Cruz", "field", ["Subject"]) == ["Ana Cruz"]
    assert values("MARIA SANTOS\nRegional Director\n\nx", "signatoryTitle") == ["Regional Director"]


PAGE = "REPUBLIC OFFICE RECORDS\nSubject : Ana Cruz\nPay ₱5,000.00 within 15 days under Section IV of the order dated 2026-01-02\n- First item of the list\n- Second item of the list\n1. Keep the copy 2. Return it\nMARIA SANTOS\nRegional Director of Records"


def test_a_page_against_itself_has_no_material_finding():
    r = k.compare_texts(PAGE, PAGE)
    assert r == {"status": "compared", "similarity": 1.0, "findings": [], "suppressed": 0}


def test_changes_are_found():
    r = k.compare_texts(PAGE.replace("5,000.00", "6,000.00"), PAGE)
    assert [(f["severity"], f["cls"], f["reason"], f["found"]) for f in r["findings"]] == [("material", "money", "digit-substitution", "₱6,000.00")]
    r = k.compare_texts(PAGE + "\nPay P700 too", PAGE)
    assert [(f["cls"], f["reason"]) for f in r["findings"]] == [("money", "added")]
    assert k.compare_texts("few words", PAGE)["status"] == "image_unreadable"
    assert k.compare_texts(" ".join(f"w{i}" for i in range(40)), PAGE)["status"] == "page_differs"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_twin():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert k.lcs_length(a, b) == slow_lcs(a, b)
