"""URL lists: the mapped index against trying every rule, with and without digest collisions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.net/en/x", "https://a.example.net/en", "ftp://x.net/", "http://x.net", "http://notexample.net/en/", "http://example.com/de/?q", "http://w.example.com/de/a#b",
    "http://x.org/fr/", "x://y://z.net/", "http://net/", "http://a..net/", "http://x.net?/", "http://x.net#/", "http://user@x.net:80/", "http://é.NET/ü", "://x.org/fr/y", "http://x.org/fr/" + "y" * 100_000,
]
BLOCK, ALLOW = ["net/", "example.com/de/", "a.net/x", "bad.org"], ["example.net/en/", "org/fr/", "a.net/x/y", ""]


def brute_force(url, block, allow):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = []
    for verdict, rules in ((1, block), (0, allow)):
        for rule in rules:
            h, slash, p = rule.partition("/")
            if host and h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), len(h), verdict, rule))
    top = max(fits, default=None)
    return host, path, top and top[3], "block" if (top[2] if top else not host) else "allow"


def test_queries_answer_like_trying_every_rule(spark):
    r = random.Random(3)
    part = lambda: r.choice("abc")
    urls = URLS + [f"http://{'.'.join(part() for _ in range(r.randint(1, 4)))}/{'/'.join(part() for _ in range(r.randint(0, 3)))}" for _ in range(500)]
    rule = lambda: ".".join(part() for _ in range(r.randint(1, 3))) + "/" + "/".join(part() for _ in range(r.randint(0, 2)))
    block, allow = BLOCK[:] + [rule() for _ in range(60)], ALLOW[:-1] + [rule() for _ in range(40)]
    pages = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(urls)], "page_id bigint, url string, rule string")
    expected = {i: brute_force(x, block, allow) for i, x in enumerate(urls)}
    pick = lambda df: {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in df.collect()}
    assert pick(u.judge(pages, block, allow)) == expected
    assert pick(u.judge_by_join(u.with_host_and_path(pages), block, allow)) == expected


def test_digest_collisions_decide_nothing(tmp_path):
    weak = lambda text: len(text) % 3
    path = tmp_path / "index"
    path.write_bytes(u.build_index(BLOCK, ALLOW, weak))
    index = u.MappedIndex(str(path), weak)
    for url in URLS:
        host, place, rule, verdict = brute_force(url, BLOCK, ALLOW)
        assert index.judge([host], [place]) == ([rule], [verdict])


@pytest.mark.parametrize("judge", [u.judge, lambda df, b, a: u.judge_by_join(u.with_host_and_path(df), b, a)])
def test_empty_list_and_table(spark, judge):
    pages = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/"), (None, None)], "page_id bigint, url string")
    assert sorted(r.verdict for r in judge(pages, [], []).collect()) == ["allow", "allow", "block"]
    assert judge(pages.filter(F.lit(False)), BLOCK, ALLOW).collect() == []
