"""Judged URLs against a plain judge."""

import random
import string

import pytest

from shelflight.llm import url_filter
from shelflight.llm.queries import URL_RULES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [
    None, "", "no scheme", "http://", "http://COM", "HTTP://Com/", "http://com?x/", "http://a.com#f/", "x://y://z.com/en/", "http://example.com/en",
    "http://example.com/en/", "http://WWW.Example.com/en/1?q=/es/", "http://m.www.example.com/en/#x", "http://notexample.com/en/", "http://net/es/", "http://a..net/fr/x",
    "http://.net/fr/", "http://x.net/ES/", "ftp://user@x.net:80/es/", "http://example.com./en/", "http://" + "a." * 3000 + "com/" + "b" * 5000, "http://é.com/ü", "://com/",
]


def plain(url, rules, listed=()):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(LOWER)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    return host, path, None, "block" if (host, path) in listed else "allow"


def judged(spark, urls, rules, listed=None, **more):
    pages = spark.createDataFrame([(i, u, "h", "r", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, row string, path string").repartition(3)
    rules = spark.createDataFrame(rules, "host string, path string, verdict string") if rules else None
    lists = spark.createDataFrame([(u,) for u in listed], "url string") if listed else None
    rows = sorted(tuple(r) for r in url_filter.judge(pages, rules, lists, **more).collect())
    assert [r[0] for r in rows] == list(range(len(urls)))
    return [r[1:] for r in rows]


def test_fixed_rules(spark):
    urls = ODD + [f"http://{a}{b}.example.{c}/{d}/{i}" for i, (a, b, c, d) in enumerate(
        (a, b, c, d) for a in ("", "www.") for b in ("x", "www") for c in ("com", "net", "org") for d in ("en", "es", "fr"))]
    assert judged(spark, urls, URL_RULES) == [plain(u, URL_RULES) for u in urls]


# Without a small bound the entries are joined by a shuffle, those of frequent keys by a broadcast.
@pytest.mark.parametrize("small", [url_filter.SMALL, 0])
@pytest.mark.parametrize("hot", [url_filter.HOT, 3])
def test_many_rules_and_a_list(spark, monkeypatch, small, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    pick = random.Random(5)
    hosts = [".".join(pick.choice("abc") for _ in range(pick.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/ab/c", "/b/"]
    rules = sorted({(h, p): v for h, p, v in ((pick.choice(hosts), pick.choice(paths), pick.choice(["allow", "block"])) for _ in range(40))}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ODD + [f"http://{pick.choice(hosts)}{pick.choice(paths)}{pick.choice(['', 'x', 'c/'])}" for _ in range(300)] + ["http://z.y/hot"] * 200
    listed = [*urls[30:90], "http://z.y/hot?x", None]
    keys = {plain(u, ())[:2] for u in listed if u is not None}
    assert judged(spark, urls, rules, listed, small=small) == [plain(u, rules, keys) for u in urls]
    assert judged(spark, urls, None, listed, small=small) == [plain(u, (), keys) for u in urls]


def test_the_filter_passes_all_entries_and_few_others(spark):
    entries = spark.range(5000).selectExpr("true as exact", "concat('h', id) as host", "'/' as path", "'block' as verdict")
    others = spark.range(5000, 55000).selectExpr("true as exact", "concat('h', id) as host", "'/' as path")
    assert url_filter.possible_hits(entries.drop("verdict"), entries, 5000).count() == 5000
    assert url_filter.possible_hits(others, entries, 5000).count() < 500


def test_no_rows_no_rules_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge(empty, rules).count() == 0
    assert judged(spark, ["http://a.com/", None], None) == [("a.com", "/", None, "allow"), ("", "", None, "allow")]
    twice = spark.createDataFrame([(None, "http://x.net/es/"), (1, "http://x.net/es/"), (1, "http://x.net/es/"), (1, "http://y.com/")], "page_id bigint, url string")
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.judge(twice, rules).collect())
    assert got == [(0, "block"), (1, "allow"), (1, "block"), (1, "block")]
    assert url_filter.judge(twice, rules.limit(0)).where("verdict = 'allow'").count() == 4
