import random

from terrapanel.llm.url_filter import RULE_SCHEMA, filter_urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "com", "x-y", "É"], ["/", "/a", "/ab", "/a/b", "/a/bc", "/b?q", "#t", "", "/A", "\U0010ffff", "/a\U0010ffff"]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(parts[:5]) + rng.choice(parts[:6]).split("?")[0]): rng.choice(["allow", "block"]) for _ in range(120)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "http://a", "x://y://a/b", "http://A.B/a?x://y", "http://a..b/a", "http://.com/a", "http://com\n/a"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(parts)}{rng.choice(parts)}{rng.choice(parts)}" for _ in range(1500)]
    urls += ["http://a.com/" + "a" * 50_000, "http://a.com/ab", "http://a.com/ab"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, kind int")
    got = {r.page_id: r for r in filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA), urls_a_salt=600).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u, rules), u


def test_ties_no_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a/x"), (1, "http://a/x"), (1, "http://a/x")], "page_id long, url string")
    both = spark.createDataFrame([("allow", "a", "/"), ("block", "a", "/")], RULE_SCHEMA)
    assert [r.verdict for r in filter_urls(pages, both).collect()] == ["block"] * 3
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert [r.rule for r in filter_urls(pages, none).collect()] == [None] * 3
    assert filter_urls(pages.limit(0), both).count() == 0


def test_a_host_of_many_labels_is_one_row(spark):
    long = ".".join(["x"] * 20_000)
    rules = [("block", "x.com", "/a"), ("allow", f"{long}.com", "/a/b"), ("block", f"x.{long}.com", "/"), ("allow", "com", "/a/b/c/d/e")]
    urls = [f"http://{long}.com/a/b/c", f"http://x.{long}.com/a", f"http://y.{long}.com/a/b", "http://com/a/b/c/d/e/f", f"http://{long}.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u, rules)


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rules = spark.sql("SELECT * FROM VALUES ('block', 'a', '/'), ('allow', 'b', '/') AS r(verdict, host, path)")
    plan = filter_urls(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
