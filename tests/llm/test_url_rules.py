from __future__ import annotations

import random

import duckdb
import pytest

from gridloom.llm import url_rules


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def brute(rows, rules):
    out = []
    for page, url in rows:
        host, path = split(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best[2] if best else None, best[3] if best else "allow"))
    return sorted(out, key=str)


def found(spark, rows, rules):
    pages = spark.createDataFrame([(p, u, "<p>", "x", 1) for p, u in rows], "page_id long, url string, html string, rule string, key int")
    return sorted((tuple(r) for r in url_rules.judge(pages, url_rules.rules_table(spark, rules)).collect()), key=str)


def test_small_table_against_brute_force_and_sql(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = sorted((tuple(r) for r in url_rules.judge(pages, url_rules.rules_table(spark)).collect()), key=str)
    assert got == brute([(r.page_id, r.url) for r in pages.collect()], url_rules.RULES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_rules.ORACLE})").fetchall(), key=str) == got


@pytest.mark.parametrize("parts", ["1", "4", "11"])
def test_nested_rules_over_partitions(spark, parts):
    rnd = random.Random(int(parts))
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "aa.com", "org", "a.org", ".com", "a..com", "com.", "é.com"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/z", "/xy"]
    rules = [(h, p, rnd.choice(["allow", "block"])) for h in hosts[:7] for p in paths if rnd.random() < 0.6]
    rows = [(i, f"{rnd.choice(['http', 'x'])}://{rnd.choice(hosts).upper() if i % 2 else rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/x', '#/x', 'tail'])}") for i in range(300)]
    rows += [(1000 + i, "http://b.a.com/x/y") for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows, rules) == brute(rows, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http:///de/"), (6, "http://x.org"), (7, "http://EXAMPLE.org/es/" + "p" * 100_000), (8, "a://b://com/de/"), (9, "http://com/de/\n/x"), (9, "http://com/de/\n/x"), (None, "http://m.com/de/a")]
    assert found(spark, rows, url_rules.RULES) == brute(rows, url_rules.RULES)
    assert found(spark, [], url_rules.RULES) == []
    assert found(spark, [(1, "http://a.com/x")], [("a.com", "/x", "allow"), ("a.com", "/x", "block")]) == [(1, "a.com", "/x", "a.com/x", "block")]


def test_a_rule_without_a_path_fits_no_host_that_only_starts_like_it(spark):
    urls = ["http://a.com/x", "http://a.com\x01b/x", "http://a.comb/", "http://x.a.com?q", "http://b\x01.a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_rules.rules_table(spark, (("a.com", "", "block"),))
    assert {r.page_id for r in url_rules.judge(pages, rules).collect() if r.verdict == "block"} == {0, 3, 4}


def test_hot_urls_without_ids_keep_all_their_rows(spark):
    pages = spark.createDataFrame([(None, "http://a.org/x")] * 300 + [(1, None)], "page_id long, url string")
    got = url_rules.judge(pages, url_rules.rules_table(spark)).collect()
    assert len(got) == 301 and sum(r.rule == "org/" for r in got) == 300
