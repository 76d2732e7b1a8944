"""URL filter against brute force on small lists and on lists of many keys."""

import random

import pytest

from corvane.llm import url_filter

URLS = [
    (1, "http://a.example.org/es/x?q#f"),
    (2, "HTTPS://Example.ORG/en/12"),
    (3, "https://notexample.org/es/x"),
    (4, "ftp://x.com/fr/"),
    (5, "http://x.com/fr"),
    (6, None),
    (7, ""),
    (8, "no scheme/es/"),
    (9, "://"),
    (10, "http://example.org"),
    (11, "http://example.org?/es/"),
    (12, "http://com/de/a://b"),
    (13, "http://a..com/de/x"),
    (14, "http://ÄB.com/de/x"),
    (1, "http://a.example.org/es/x?q#f"),
]


def judged(url: str | None, entries, default: str = "allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for rule, verdict in entries:
        if rule is None or "/" not in rule:
            continue
        at, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == at or host.endswith("." + at)) and path.startswith(start):
            fits.append((len(rule), rule, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, default)
    return host, path, rule, verdict


def compared(spark, urls, entries, **more):
    pages = spark.createDataFrame([(i, u, "z", 0, 0) for i, u in urls], "page_id long, url string, html string, block long, n int")
    out = url_filter.filter_urls(pages, spark.createDataFrame(entries, "rule string, verdict string"), **more)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, *judged(u, entries, **more)) for i, u in urls), key=repr)
    return got


def test_rules(spark):
    got = {r[0]: r[3:] for r in compared(spark, URLS, url_filter.RULES)}
    assert got[1] == ("example.org/es/", "block") and got[2] == ("example.org/en/1", "block") and got[3] == ("org/", "allow") and got[10] == (None, "allow")


def test_default_and_empty_list(spark):
    compared(spark, URLS, [], default="block")
    compared(spark, URLS, [("com/fr/", "allow"), (None, "block"), ("nopath", "block")], default="block")


def test_empty_pages(spark):
    compared(spark, [], url_filter.RULES)


def test_entries_that_repeat(spark):
    got = compared(spark, URLS, [("com/fr/", "allow"), ("com/fr/", "block"), ("com/fr/", "allow")])
    assert [r[4] for r in got if r[0] == 4] == ["block"]


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_long_list(spark, monkeypatch, broadcast):
    """Thousands of keys, with the filter broadcast and joined by block."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", broadcast)
    r = random.Random(5)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    entries = [(f"{word()}.{word()}/{word()[: r.randint(0, 2)]}", r.choice(["allow", "block"])) for _ in range(3000)]
    urls = [(i, f"http://{word()}.{word()}.{word()}/{word()}{word()}/") for i in range(2000)]
    got = compared(spark, urls, entries)
    assert 100 < sum(x[3] is not None for x in got) < 2000 or broadcast


def test_bloom_keeps_all_listed_keys(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    blocks, n = url_filter.bloom_blocks(keys, 5000)
    assert url_filter.bloom_pass(keys, blocks, n).count() == 5000
    others = spark.range(5000, 25000).selectExpr("concat('k', id) as key")
    assert url_filter.bloom_pass(others, blocks, n).count() < 1000  # 16 bits a key


def test_names_and_urls_without_a_host(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (3, "none"), (4, "http://a.org")], "`page.id` int, `the url` string")
    out = url_filter.filter_urls(pages, spark.createDataFrame([("org/", "block")], "rule string, verdict string"), "page.id", "the url")
    assert {tuple(r) for r in out.collect()} == {(1, "a.org", "/x", "org/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "", None, "allow")} and out.columns[0] == "page.id"
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, pages, "HOST")
