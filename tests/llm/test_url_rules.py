import pytest

from attestra.llm import url_rules
from attestra.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "https://A.Example.COM/en/7?x#y", "https://example.com/en/71", "https://example.com/en", "https://badexample.com/en/7", "http://x.net/de/", "http://a.b.example.net/de/8#",
    "http://example.net?de/8", "ftp://org/es/x", "http://org#/es/", "http://É.org/es/", "http://a..com/en/", "http://com./en/", "x://y://com/en/", "http://" + "a." * 3000 + "com/en/7", "http://example.com/en/7" + "z" * 100_000, "http://com/EN/",
]


def test_against_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 2)]
    rules = [*URL_RULES, ("block", "c.example.org", ""), ("allow", "c.example.org", ""), ("allow", "", "/x"), ("block", None, "/"), ("block", "z.org", None)]
    rows += [(900, "http://c.example.org/q"), (901, "http://d.c.example.org"), (902, "http://z.org/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    plain = [(v, h, p or "") for v, h, p in rules if h]
    expected = sorted((k, *brute(u, plain)) for k, u in rows)
    got = url_rules.judge(pages, url_rules.rules_table(spark, rules)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_large_rule_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string")
    got = url_rules.judge(pages, url_rules.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *brute(u, URL_RULES)) for k, u in enumerate(URLS)), key=str)


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id bigint, url string")
    rules = url_rules.rules_table(spark, URL_RULES)
    assert url_rules.judge(pages, rules.limit(0), default="block").first().verdict == "block"
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    with pytest.raises(ValueError):
        url_rules.judge(pages.withColumnRenamed("page_id", "Host"), rules)
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
