"""Cuts and orders against a plain reading of the rules, and the way back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import fill_in_middle as fim

TEXTS = [None, "", "a", "ab\ncd\r\n\U0001f642é", "holds <S> a mark", "<", "<P", "x" * 5, "<<P<S<M>", "déjà " * 50_000]


def brute(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_as_the_rules_say(spark):
    """Nulls, empty and long texts, marks in texts, repeated rows, clashing columns."""
    rows = [(k if k % 11 else None, TEXTS[k % len(TEXTS)]) for k in range(200)] * 2
    docs = spark.createDataFrame([(i, t, "f", 1, "o") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    made = fim.fill_in_middle(docs).cache()
    expected = sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert sorted(map(tuple, made.collect()), key=repr) == expected
    assert {x[2] for x in expected} == {"plain", "psm", "spm"}
    back = sorted(map(tuple, fim.restore(made).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    digests = fim.with_digests(made)
    assert digests.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, digests.collect()), key=repr) == sorted(((i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in rows), key=repr)
    assert fim.with_digests(fim.fill_in_middle(docs.limit(0))).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(), st.integers(0, 10**6))
def test_code_points(text, doc_id):
    n, form, a, m, output = fim.cut(str(doc_id), text, fim.Spec())
    assert (n, form, a, m, output) == brute(doc_id, text)
    assert fim.rebuilt(output, form, fim.Spec()) == text


@pytest.mark.parametrize("unit", [r"\w+|\W", r"[^\n]*\n|[^\n]+", r"\X", r"[a-z]"])
def test_other_units(unit):
    spec = fim.Spec(unit=unit, plain_from=100)
    for text in [t for t in TEXTS[2:9]] + ["Some words.\n\nAnd a line " * 400]:
        ends = list(fim.unit_ends(text, unit))
        assert ends == [x.end() for x in fim.regex.finditer(unit, text, fim.regex.DOTALL)]
        for doc_id in range(20):
            n, form, a, m, output = fim.cut(str(doc_id), text, spec)
            assert n == len(ends) and fim.rebuilt(output, form, spec) == text
            assert form == "plain" or {a, a + m} <= {0, *ends}


def test_refused():
    for wrong in ({"unit": "a*"}, {"marks": ("<P>", "<P>x", "<M>")}, {"marks": ("aba", "c", "d")}, {"marks": ("", "c", "d")}):
        with pytest.raises(ValueError):
            fim.Spec(**wrong)
