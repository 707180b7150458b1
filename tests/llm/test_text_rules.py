"""Quality rules, url filters and license scans against brute force."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import license_scan, license_texts, quality_rules, url_filter
from corpusloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    where = {}
    for i in range(n - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = [max((k for j in range(n) if j != i for k in [next((k for k in range(n) if max(i, j) + k >= n or words[i + k] != words[j + k]), n)]), default=0) for i in range(n)]
    spans = {j for i, k in enumerate(longest) if k >= 10 for j in range(i, i + k)}
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(spans), max(longest, default=0))


def test_rules(spark):
    r = random.Random(2)
    texts = [None, "", " \n ", "one", "a " * 200, "The The\nThe The\n\nThe The", "é|# x\x0by\x1cz\n" * 3, "x" * 5000]
    for _ in range(25):
        words = [r.choice("abcd") * r.randint(1, 3) for _ in range(r.randint(5, 90))]
        part = words[: r.randint(1, len(words))]
        texts.append(" ".join(words + part * r.randint(0, 2)))
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {x.doc_id: x for x in quality_rules.quality_rules(rows).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], base(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.covered_words, x.longest_repeat) == want, t
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert x.base_failed == failed and x.kept == (not failed and want[5] <= 0.25 * want[0] and want[6] <= 64)
    assert quality_rules.quality_rules(rows.where("false")).count() == 0


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, ok) for h, p, ok in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, "allow" if not best or best[2] else "block"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?y#z", "http://example.org/en/123", "http://a.b.example.org/en/1", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/frx", "https://com/de/", "http://x.com?fr/", "a://b://c/d", "http://ÉX.com/de/é\n", "http://org", "http://org/", "http://x.com/de/" + "y" * 9000]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(rows, URL_RULES).collect()}
    assert got == {i: judge(u, URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(rows, []).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(rows.where("false"), URL_RULES).count() == 0
    # A list in several ranges of digests judges alike.
    split = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(rows, URL_RULES, per_file=2).collect()}
    assert split == got and len(url_filter.publish(spark, URL_RULES, per_file=2)) == 3


def test_long_urls_and_long_lists(spark):
    """A host of a megabyte of dots has few probes; a list of a million rules, in ranges, judges as brute force does."""
    import time

    rules = URL_RULES + [(f"{k % 7}.host{k}.example", f"/p{k % 1000}/", bool(k % 2)) for k in range(1_000_000)]
    urls = ["http://" + "." * 1_000_000 + "x.com/de/a", "http://" + "a." * 500_000 + "example.org/es/" + "y" * 100_000, "http://3.host10.example/p10/x", "http://www.3.host10.example/p10/x", "http://3.host11.example/p11/x", "http://4.host11.example/p11/x", "http://4.host11.example/p1/x", "http://host11.example/p11/"]
    shapes = [(n, size) for n in (1, 2, 3) for size in range(1, 9)]
    began = time.time()
    assert len(list(url_filter.probes("." * 1_000_000 + "x.com", "/de/a", shapes))) <= len(shapes) and time.time() - began < 1
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, per_file=300_000).collect()}
    near = URL_RULES + [r for r in rules[len(URL_RULES) :] if r[0].endswith((".host10.example", ".host11.example"))]
    assert got == {k: judge(u, near) for k, u in enumerate(urls)}
    assert [got[k][3] for k in range(8)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow"]


@pytest.mark.parametrize("seed", range(3))
def test_urls_by_chance(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "co", ""]
    rules = [(".".join(r.choice(names[:3]) for _ in range(r.randint(1, 3))), "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3))), r.random() < 0.5) for _ in range(25)]
    rules = list({(h, p): (h, p, ok) for h, p, ok in rules}.values())
    urls = ["http://" + ".".join(r.choice(names) for _ in range(r.randint(1, 5))) + r.choice(["", "/", "?"]) + "".join(r.choice("xy/") for _ in range(r.randint(0, 4))) for _ in range(300)]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, per_file=7).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = judge(u, rules)
        assert got[k][:2] == (host, path) and len(got[k][2] or "") == len(rule or "")
        assert rule != got[k][2] or verdict == got[k][3]


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    url_filter.DigestArray.write(str(tmp_path / "d"), [("a.com", "/", False), ("b.com", "/x", True), ("cc.org", "/", False)])
    held = url_filter.DigestArray(str(tmp_path / "d"))
    assert held.lookup([b"a.com/", b"z.com/", b"b.com/x", b"cc.org/", b"dd.org/"]) == [False, None, True, False, None]


def test_licenses(spark):
    t = license_scan.TEMPLATES
    apache = t["apache-2.0"]
    changed = apache.replace("distributed under", "given under").replace("governing permissions", "on permissions")
    texts = [None, "", "nothing here", "x. " + t["mit-notice"] + " y", "É " + t["gpl-3.0-notice"].upper(), "a " + apache + " b", changed, apache[:200], (t["isc"] + "\n") * 2, "w " * 30000 + t["cc-by-nc-4.0-notice"]]
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, coverage int")
    got = {}
    for r in license_scan.scan_licenses(rows).collect():
        got.setdefault(r.doc_id, []).append(r)
    names = {i: sorted(r.license for r in rs) for i, rs in got.items()}
    assert names[3] == ["mit-notice"] and names[4] == ["gpl-3.0-notice"] and names[9] == ["cc-by-nc-4.0-notice"]
    assert "apache-2.0" in names[5] and "apache-2.0" in names[6] and "apache-2.0" not in names.get(7, []) and names[8] == ["isc", "isc"]
    assert not {0, 1, 2} & set(names)
    one = got[3][0]
    assert texts[3][one.span_start : one.span_end] == "Released under the MIT License" and one.coverage == 1.0
    part = next(r for r in got[6] if r.license == "apache-2.0")
    assert 0.9 < part.coverage < 1 and license_scan.scan_licenses(rows.where("false")).count() == 0


def test_alignment_against_a_full_one():
    """A longest common subsequence, without tolerance, wherever it is as long as asked for; the stretch is where it is complete first."""
    r = random.Random(4)
    for k in range(400):
        template = np.asarray([r.randint(0, 50 if k % 2 else 4) for _ in range(r.randint(1, 20))], np.uint64)
        text = [w for w in template.tolist() for _ in range(r.choice([1, 1, 1, 1, 0, 2])) if r.random() > 0.05]
        at = r.randint(0, len(text))
        text = np.asarray([r.randint(0, 9) for _ in range(r.randint(0, 9))] + text[:at] + [99] * r.choice([0, 0, 30]) + text[at:], np.uint64)
        longest = lcs(template, text)
        for least in range(1, len(template) + 1):
            got = license_scan.stretch(template, text, least)
            assert (got is None) == (longest < least)
            if got:
                n, a, b = got
                assert n == longest == lcs(template, text[a:b]) > max(lcs(template, text[a + 1 : b]), lcs(template, text[: b - 1]))


@pytest.mark.parametrize("inserted", [9, 30, 300])
def test_insertions_and_deletions_in_a_long_template(inserted):
    scanner = license_scan.Scanner(license_texts.every(license_scan.TEMPLATES))
    whole = next(text for name, text, _ in license_texts.every({}) if name == "GPL-3-text").split()
    n = len(license_scan.tokens(" ".join(whole).encode()))
    at = len(whole) // 2
    text = " ".join(["lead", *whole[:at], *(f"zq{k}" for k in range(inserted)), *whole[at:], "tail"])
    (got,) = scanner.scan(text.encode(), 0.8)
    assert got[:4] == ("GPL-3-text", 1.0, n, n + inserted)
    less = " ".join(whole[:at] + whole[at + inserted :])
    (got,) = scanner.scan(less.encode(), 0.8)
    left = len(license_scan.tokens(less.encode()))
    assert got[0] == "GPL-3-text" and left <= got[2] <= left + 2 and got[3] >= left - 2


def test_many_matches_and_repeated_rows(spark):
    """300 copies of a text, and a megabyte of notices, in one text each."""
    import time

    scanner = license_scan.Scanner(license_texts.every(license_scan.TEMPLATES))
    mit = license_texts.SHORT_TEXTS["mit-text"]
    began = time.process_time()
    assert [x[0] for x in scanner.scan(("\n".join([mit] * 300)).encode(), 0.8)] == ["mit-text"] * 300
    notices = ["Released under the MIT License", "licensed under Apache License 2.0", "Available under the CC BY-SA 4.0"]
    many = ". And ".join(notices * (1_000_000 // sum(len(x) + 6 for x in notices)))
    found = scanner.scan(many.encode(), 0.8)
    assert [x[0] for x in found] == ["mit-notice", "apache-2.0-notice", "cc-by-sa-4.0-notice"] * (len(found) // 3) and len(found) == many.count(". And ") + 1
    assert time.process_time() - began < 20
    rows = spark.createDataFrame([(1, "é " + mit), (1, "é " + mit), (2, "released under our MIT License; released under the MTI License")], "doc_id long, text string")
    got = sorted(map(tuple, license_scan.scan_licenses(rows).collect()))
    assert [(x[0], x[1], x[2]) for x in got] == [(1, "mit-text", 1.0)] * 2 and got[0][5] == 2


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]
