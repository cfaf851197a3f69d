from __future__ import annotations

import random

import numpy as np
import pytest

from wayfind.llm.queries import URL_RULES
from wayfind.llm.url_filter import DigestArray, filter_urls, pack

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "ftp://net", "http://net/", "http://sub.net?x=/en/",
    "http://example.com/de/1", "http://badexample.com/de/1", "http://x.example.com/dex", "http://w.org/fr/", "http://org#/fr/", "a://b://c.net/en/",
    "http://é.example.net/en/ü", "http://x.net" + "/very" * 5000,
]


def brute(url: str | None, rules: list[tuple[str, str]]) -> tuple:
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(r), r, v) for r, v in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def pages(spark, urls):
    rows = [(i if i % 5 else None, u, "r", "v", 1) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string, code int")


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_contract_rules(spark, limit):
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    out = filter_urls(pages(spark, URLS), rules, max_mapped_bytes=limit)
    assert sorted(map(str, ((r.host, r.path, r.rule, r.verdict) for r in out.collect()))) == sorted(str(brute(u, list(URL_RULES))) for u in URLS)
    assert set(out.columns) == {"page_id", "url", "host", "path", "rule", "verdict", "code"}


@pytest.mark.parametrize(("limit", "bits"), [(1 << 28, 64), (1 << 28, 6), (0, 64)])
def test_many_rules_with_collisions(spark, limit, bits):
    rng = random.Random(5)
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("com", "org", "net")]
    rules = {f"{rng.choice(hosts)}/{rng.choice(['', 'x/', 'x/y', 'z/'])}": rng.choice(["allow", "block"]) for _ in range(80)}
    urls = [f"http://{rng.choice(['', 'www.', 'm.n.'])}{rng.choice(hosts)}/{rng.choice(['', 'x/q', 'x/y/z', 'z/z', 'w'])}" for _ in range(400)]
    frame = spark.createDataFrame([*rules.items(), *list(rules.items())[:9]], "rule string, verdict string")
    got = sorted((r.host, r.path, str(r.rule), r.verdict) for r in filter_urls(pages(spark, urls), frame, max_mapped_bytes=limit, bits=bits).collect())
    assert got == sorted((h, p, str(r), v) for h, p, r, v in (brute(u, list(rules.items())) for u in urls))


def test_colliding_digests_are_told_apart_by_their_strings():
    keys = [f"h{i}/" for i in range(200)]
    array = DigestArray(pack([(k, "block") for k in keys], bits=3))
    assert (array.find(keys) == 1).all()
    assert (array.find([f"g{i}/" for i in range(200)]) == -1).all()
    assert (np.diff(array.digests) >= 0).all()


def test_empty_lists_and_tables(spark):
    nothing = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in filter_urls(pages(spark, URLS), nothing).collect()} == {"allow"}
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    assert filter_urls(pages(spark, URLS).limit(0), rules).count() == 0


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_equally_long_rules(spark, limit):
    rules = spark.createDataFrame([("a.org/", "block"), ("org/ab", "allow"), ("org/abc", "block"), ("a.org/a", "allow")], "rule string, verdict string")
    out = filter_urls(pages(spark, ["http://a.org/ab", "http://a.org/", "http://a.org/abc"]), rules, max_mapped_bytes=limit)
    assert {(r.path, r.rule, r.verdict) for r in out.collect()} == {("/ab", "a.org/a", "allow"), ("/", "a.org/", "block"), ("/abc", "a.org/a", "allow")}
    out = filter_urls(pages(spark, ["http://a.org/ab"]), rules.where("rule <> 'a.org/a'"), max_mapped_bytes=limit)
    assert [(r.rule, r.verdict) for r in out.collect()] == [("a.org/", "block")]
