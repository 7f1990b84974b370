"""URL filters against brute force, odd urls and rules, and the plan."""

from __future__ import annotations

import random
import re

import pytest
from conftest import plan_of
from helpers import with_clashes
from pyspark.sql import functions as F

from chartloom.llm import urlfilter

URLS = "page_id long, url string"
LISTED = "verdict string, rule string"


def parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute(url, rules):
    host, path = parts(url)
    fits = []
    for verdict, rule in rules:
        if rule is None or verdict is None:
            continue
        at = rule.find("/") if "/" in rule else len(rule)
        own, start = rule[:at].lower(), rule[at:]
        if own and (host == own or host.endswith("." + own)) and path.startswith(start):
            fits.append((len(own + start), len(own), verdict, own + start))
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def random_case(seed, n_urls, n_rules):
    rng = random.Random(seed)
    host = lambda most: ".".join(rng.choice(["a", "b", "net", "x-y", "é"]) for _ in range(rng.randint(1, most)))
    path = lambda most: "".join(rng.choice(["/", "/a", "b", "/é", "~"]) for _ in range(rng.randint(0, most)))
    rules = [(rng.choice(["block", "allow"]), host(3) + "/" * rng.randint(0, 1) + path(4)) for _ in range(n_rules)]
    urls = [(k, f"{rng.choice(['http', 'x'])}://{host(5)}{'/' * rng.randint(0, 1)}{path(6)}{rng.choice(['', '?q=/a', '#b'])}") for k in range(n_urls)]
    return urls, rules


@pytest.mark.parametrize("seed,sweep_rows", [(1, 1_000_000), (2, 3), (3, 20)])
def test_verdicts_equal_brute_force(spark, seed, sweep_rows):
    urls, rules = random_case(seed, 500, 150)
    got = urlfilter.judge(spark.createDataFrame(urls, URLS), spark.createDataFrame(rules, LISTED), sweep_rows=sweep_rows).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: brute(u, rules) for k, u in urls} and len(got) == len(urls)


def test_nested_rules_open_and_close(spark):
    rules = [("block", "net/"), ("allow", "net/a"), ("block", "net/ab/c"), ("allow", "net/ab"), ("block", "b.net/a"), ("allow", "net")]
    urls = ["http://net/", "http://net/a", "http://net/ab", "http://net/ab/", "http://net/ab/cd", "http://net/ac", "http://net/b", "http://net", "http://x.b.net/ab", "http://b.net/", "http://ne/"]
    rows = list(enumerate(urls))
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(spark.createDataFrame(rows, URLS), spark.createDataFrame(rules, LISTED)).collect()}
    assert got == {k: brute(u, rules) for k, u in rows}


def test_odd_urls_and_rules(spark):
    long = "http://" + "a." * 20_000 + "net/" + "x" * 100_000
    rows = [(1, None), (2, ""), (3, "net/en/"), (4, "HTTP://WWW.Example.NET/en/1?x"), (4, "HTTP://WWW.Example.NET/en/1?x"), (None, "http://net/"), (6, "http://xnet/"),
            (7, "http://net:80/"), (8, "a://b://net/"), (9, "http://net?/"), (10, "http://net#/"), (11, long), (12, "://\n/\n"), (13, "http://..net/é"), (14, "http://É.net/"), (15, "http://net./")]
    rules = list(urlfilter.RULES) + [("block", None), (None, "net/é"), ("block", "/x"), ("block", ""), ("allow", "net/"), ("block", "net/")]
    got = urlfilter.judge(with_clashes(spark.createDataFrame(rows, URLS)).withColumn("host", F.lit(1)), with_clashes(spark.createDataFrame(rules, LISTED))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, *brute(u, rules)) for k, u in rows), key=repr)


def test_clashing_case_and_empty_tables(spark):
    urls, rules = spark.createDataFrame([(1, "http://a.net/x")], URLS), spark.createDataFrame(list(urlfilter.RULES), LISTED)
    names = ["page_id", "URL", "url", "Host", "path"]
    clash = urls.select("page_id", F.lit("http://a.org/fr/"), "url", F.lit(1), F.lit(2)).toDF(*names)
    assert [tuple(r) for r in urlfilter.judge(clash, rules).collect()] == [(1, "a.net", "/x", "net/", "block")]
    assert urlfilter.judge(urls.limit(0), rules).count() == 0
    assert [tuple(r) for r in urlfilter.judge(urls, rules.limit(0)).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_no_python_in_the_plan(spark):
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, urlfilter.RULES))} AS t(verdict, rule)")
    plan = plan_of(urlfilter.judge(spark.range(9).select(F.col("id").alias("page_id"), F.format_string("http://a%s.net/x", "id").alias("url")), rules))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan) and "Window" in plan
