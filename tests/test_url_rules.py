"""Rules by index equal rules tried on every url."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import policy
from loomwork.operators import url_rules as R

RULES = "rule_id int, site string, host string, subdomains boolean, pattern string"


def test_index_equals_trying_all(spark):
    rng = np.random.default_rng(2)
    hosts = ["a.test", "m.a.test", "x.m.a.test", "b.test", "ba.test", "test"]
    parts = ["", "/", "/en", "/en/", "/en/1", "/en/12/z", "/de/a/b/c/d", "/a?", "//x", "/en?q=1/2", "/en/1#frag/9"]
    urls = [f"http://{h}{p}" for h in hosts for p in parts] + [None, "", "no host", "HTTP://A.Test/en/1"]
    patterns = ["^/en/", "^/en/[0-9]+", "^/en/?", "^/en/?$", "en", "^/de/a/b/c", "^/de/a/b*", "^/(en|de)/", "^/en/|^/de/", "^$", "^", "/z$", "^/en/1+2", "^(a+)+$", None, "", "q=1", "^/e{1}n", "^/de/a/{1}b", "^/a\\?"]
    rules = [(i, "s", str(rng.choice([*hosts, "A.TEST"])), bool(rng.integers(0, 2)) if i % 5 else None, p) for i, p in enumerate(patterns * 12)] + [(9000, "s", None, True, "en"), (9001, "s", "", True, "en")]
    pages = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(urls)], "id long, url string, pattern string, host string")
    got = sorted((r["id"], r["rule_id"]) for r in R.matches(pages, "id", "url", spark.createDataFrame(rules, RULES)).collect())
    want = []
    for i, u in enumerate(urls):
        m = re.match("[a-zA-Z]+://([^/?#:]*)([^?#]*)", u or "")
        if m and m[1]:
            own, q = m[1].lower(), re.match("[^?#]*[?]([^#]*)", u)
            part = m[2] + ("?" + q[1] if q and q[1] else "")
            want += [(i, n) for n, _, h, below, p in rules if h and p and policy.safe_pattern(p) and (own == h.lower() or (below and own.endswith("." + h.lower()))) and re.search(p, part)]
    assert got == sorted(want) and len(want) > 300


@pytest.mark.parametrize("pattern, start", [("^/en/[0-9]", "/en/"), ("^/en", "/"), ("^/a/b/c/d/e", "/a/b/c/"[:5]), ("^/en/?x", "/"), ("^/en/+x", "/"), ("en/", ""), ("^/en/|x", ""), ("^", ""), ("^a/b", ""), ("^/a\\.b/c", "/")])
def test_fixed_starts(spark, pattern, start):
    assert spark.createDataFrame([(pattern,)], "p string").select(R.fixed_start(F.col("p"))).first()[0] == start


def test_thousands_of_rules_are_one_join(spark):
    rules = spark.range(5000).select(F.col("id").cast("int").alias("rule_id"), F.lit("s").alias("site"), F.concat(F.lit("h"), F.col("id") % 50, F.lit(".test")).alias("host"), F.lit(False).alias("subdomains"), F.concat(F.lit("^/f"), "id", F.lit("/[0-9]+$")).alias("pattern"))
    pages = spark.range(2000).select("id", F.concat(F.lit("https://h"), F.col("id") % 50, F.lit(".test/f"), F.col("id"), F.lit("/7")).alias("url"))
    out = R.matches(pages, "id", "url", rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.where("id = rule_id").count() == out.count() == 2000 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("RLIKE") <= 8  # no expression a rule


def test_reapplied_rules_come_and_go(spark):
    pages = spark.createDataFrame([(1, "https://a.test/en/1", None, "a"), (2, "https://a.test/de/1", "http_4xx", "a"), (3, "http://a.test/en/2", None, "a"), (4, None, "excluded_rules", "a"), (5, "https://b.test/x", "excluded_rules", "b"), (6, "https://a.test/en/3?utm_source=q", "excluded_rules", "a"), (7, "https://c.test/", None, None)], "id long, url string, error string, site string")
    rules = spark.createDataFrame([(1, "a", "a.test", False, "^/en/"), (2, "a", "a.test", False, "^/en/[0-9]"), (3, "b", "b.test", False, "^(a+)+$")], RULES)
    read = lambda rules: {r["id"]: tuple(r[1:]) for r in R.reapplied(pages, "id", "url", "error", "site", rules).collect()}
    out, gone = "excluded_rules", (False, None, True)
    assert read(rules) == {1: (False, None, False), 2: (True, out, True), 3: (True, out, True), 4: gone, 5: gone, 6: (True, out, False), 7: (False, None, False)}
    assert read(rules.where("rule_id > 2"))[2] == (False, "http_4xx", False)


def test_variants_of_a_url(spark):
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x/"), (3, "http://a/x"), (4, "http://a/y/"), (5, None)], "id long, url string")
    asked = spark.createDataFrame([("http://a/x",), ("http://a/x/",), ("http://a/y",), ("http://a/z",), (None,)], "asked_url string")
    assert {r["asked_url"]: r["id"] for r in R.by_variants(pages, "id", "url", asked).collect()} == {"http://a/x": 1, "http://a/x/": 2, "http://a/y": 4}
