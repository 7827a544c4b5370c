"""The URL filter against plain loops, and its Bloom filter alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from symgrove.llm import queries, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:end].translate(LOWER), rest[end:]
        path = rest[:min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    best = max(((len(h + p), len(h), h + p, v) for v, h, p in rules
                if host and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[2] if best else None, best[3] if best else default


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "b.a.org", ""), ("block", "a.org", "/xy"),
         ("allow", "same.net", "/p"), ("block", "same.net", "/p")]


def test_urls_against_loops(spark):
    draw = random.Random(2)
    hosts = ["org", "ORG", "example.org", "b.example.org", "notexample.org", "x.com", "com", "b.a.org", "c.b.a.org", "a.org",
             "same.net", "", "é.org", "a..org", "org.", "u:p@example.org:80"]
    urls = [f"{draw.choice(['http', 'https', ''])}{draw.choice(['://', '://', ':/', '://'])}{draw.choice(hosts)}"
            f"{draw.choice(['', '/', '/es/', '/en/1', '/en/12/x', '/fr/://', '/de/', '/xyz', '/p', '/ES/'])}"
            f"{draw.choice(['', '?q=/de/', '#/es/', '?a://b'])}" for _ in range(1500)]
    urls += [None, "", "://", "http://", "a b://c/d", "x" * 9000 + "://" + "y." * 3000 + "org/" + "z" * 9000]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES + [("block", None, "/"), ("block", "", "/"), ("maybe", "org", "/"), ("allow", "null.net", None)],
                                  "verdict string, host string, path string")
    got = url_filter.filter_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], RULES + [("allow", "null.net", "")]), r["url"]
    assert got.count() == len(urls)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/xyz"), (1, "http://c.com/de/")],
                               "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert sorted((r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()) == [
        ("a.org/xy", "block"), ("com/de/", "block"), ("org/", "allow"), ("org/", "allow")]
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0
    none = url_filter.filter_urls(df, rules.where("false"), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in none] == [(None, "block")] * 4


def test_bloom_filter_misses_nothing_and_passes_little(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    blocks = 512                                                # about 26 bits a key
    filter_ = url_filter.bloom_blocks(keys, blocks)
    assert filter_.count() <= blocks
    passes = lambda df: url_filter._may_hold(df, F.xxhash64("id"), filter_, blocks).count()
    assert passes(spark.range(5000)) == 5000
    assert passes(spark.range(10_000, 60_000)) < 500


def test_plan_is_native(spark, sf):
    plan = queries.op1_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
