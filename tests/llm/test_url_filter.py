import re

import numpy as np
import pytest

from tidewater.llm.common import mixed
from tidewater.llm.queries import URL_RULES
from tidewater.llm.url_filter import Level, cascade, contains, judge


def plain(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return url, host, path, best[2], best[3]


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x", "https://example.com/en/71", "http://com/en/", "http://notexample.com/en/7", "http://x.example.net/de/8#a", "http://net/de/", "net/de/",
        "http://org?x/es/", "ftp://a.org/es/b://c.com/en/", "http://com./en/", "http://.com/en/", "http://example.com:80/en/7", "http://É.org/es/", "x\n://a.org/es/\nb", "http://" + "a." * 5000 + "com/en/" + "x" * 100_000]


def test_urls_are_judged_as_by_a_loop(spark):
    rows = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, host string, _n int")
    for rules in (URL_RULES, [], [("com", "", "block"), ("example.com", "/en", "allow"), ("b.a.org", "/", "block")]):
        got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in judge(rows, rules).collect()), key=str)
        assert got == sorted((plain(u, rules) for u in URLS + URLS[:4]), key=str)
    assert judge(rows.limit(0), URL_RULES).collect() == []


def test_many_rules_have_mistaken_keys_and_stay_exact(spark):
    rules = [(f"h{i}.com", f"/p{i % 7}", ("allow", "block")[i % 3 == 0]) for i in range(0, 3000, 2)]
    rows = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 7 if i % 5 else 8}/x") for i in range(6000)], "page_id long, url string")
    got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in judge(rows, rules).collect()), key=str)
    assert got == sorted((plain(r.url, rules) for r in rows.collect()), key=str)


def test_classes_of_hashes_and_clashing_names(spark, monkeypatch):
    """A list beyond one class has a cascade for each: the same verdicts. Columns of the operator's own names stay."""
    from tidewater.llm import url_filter

    rules = [(f"h{i}.com", f"/p{i % 7}", ("allow", "block")[i % 3 == 0]) for i in range(0, 3000, 2)]
    rows = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 7 if i % 5 else 8}/x", "k", True) for i in range(6000)], "page_id long, url string, _keys string, _known boolean")
    monkeypatch.setattr(url_filter, "CLASS", 200)
    got = judge(rows, rules)
    assert got.columns == ["page_id", "url", "_keys", "_known", "host", "path", "rule", "verdict"]
    assert sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == sorted((plain(r.url, rules) for r in rows.collect()), key=str)


def test_cascade_tells_the_universe_exactly():
    keys = mixed(np.arange(1, 20001, dtype=np.uint64))
    listed, rest = keys[:1000], keys[1000:]
    first = Level.of(listed, 0.2)
    levels = cascade(listed, rest[first.has(rest)], first)
    assert len(levels) > 3 and contains(levels, listed).all() and not contains(levels, rest).any()


def test_two_rules_for_one_key_are_refused(spark):
    with pytest.raises(ValueError):
        judge(spark.createDataFrame([("x",)], "url string"), [("a.com", "/", "allow"), ("a.com", "/", "block")])
