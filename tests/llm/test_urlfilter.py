import random

import pytest

from helpers import clashing
from millrace.llm import urlfilter as uf

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no-scheme.com/x", "http://", "http://EXAMPLE.com/en/a?b#c", "https://www.Example.com/en/", "http://a.www.example.com/en/x", "http://example.com", "http://example.com?en", "http://x.net/es/1", "http://net/fr/",
    "http://xnet/fr/", "http://com/", "http://a.com/\n/x", "a://b://c.com/", "http://ÄB.com/en/", "http://" + "a." * 3000 + "net/es/", "http://x.net/es/1", "http://example.com:80/en/", "http://.com/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h + p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def check(spark, urls, rules):
    df = clashing(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES).repartition(3))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [brute(u, rules) for u in urls]


def test_against_brute_force(spark):
    check(spark, URLS, uf.RULES)


def test_many_rules_in_several_cascades_and_passes(spark, monkeypatch):
    rng = random.Random(6)
    hosts = [f"h{i}.{rng.choice(['com', 'net'])}" for i in range(400)]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts[:250] for p in rng.sample(["/", "/a/", "/b/", "/ab"], 2)}.values())
    urls = [f"http://{rng.choice(['', 'x.', 'y.x.'])}{h}{rng.choice(['/', '/a/1', '/b/2', '/abc', ''])}" for h in hosts for _ in range(5)]
    monkeypatch.setattr(uf.build, "__defaults__", (60,))
    monkeypatch.setattr(uf, "PASS_BYTES", 1)
    check(spark, urls, rules)


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(500).selectExpr("concat('k', id * 7) AS key")
    universe = spark.range(20000).selectExpr("concat('k', id) AS key").union(spark.createDataFrame([(None,)], "key string"))
    (cascade,) = uf.build(listed.union(listed), universe)
    assert len(cascade.levels) >= 2
    keys = universe.select("key", uf.hashes(uf.F.col("key"))[0].alias("a"), uf.hashes(uf.F.col("key"))[1].alias("b")).where("key is not null").toPandas()
    found = cascade(keys.a.to_numpy().view("uint64"), keys.b.to_numpy().view("uint64"))
    want = [int(k[1:]) % 7 == 0 and int(k[1:]) < 3500 for k in keys.key]
    assert found.tolist() == want


@pytest.mark.parametrize("rules", [[], [("block", "a.com", "")], [("block", "a.com", "/"), ("allow", "a.com", "/")]])
def test_few_rules(spark, rules):
    check(spark, ["http://a.com", "http://a.com/x", "http://b.com/"], rules)


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], PAGES), uf.RULES).count() == 0
