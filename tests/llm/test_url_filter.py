import re

import pytest

from tidemark.llm.url_filter import judge_urls, rule_table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "a.b.com/x"), ("allow", "a.b.com/x/y"), ("block", "b.com/x/y/zz"), ("block", "dup.org/"),
         ("allow", "dup.org/"), ("block", "co.uk")]
URLS = ["http://www.example.com/en/1", "https://EXAMPLE.com/en/", "http://x.example.com/en/a?b", "http://example.com/fr/",
        "http://example.com", "http://example.com?q=/en/", "http://notexample.com/en/1", "http://a.b.com/x/y/zz",
        "http://c.a.b.com/xq", "http://b.com/x/y/zzz", "http://q.net/es/1#top", "http://q.net/esp", "http://net/es/",
        "ftp://dup.org/1", "http://w.dup.org/", "http://bbc.co.uk", "http://co.uk/a", "http://uk/", "no scheme", "",
        None, "http://", "http:///en/", "http://a..com/", "http://.com/", "x://y://example.com/en/", "http://com/",
        "http://é.com/\n/x", "http://example.com/en/" + "a/" * 3000]


def _expected(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for verdict, rule in RULES:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fits.append((len(rule), len(rule_host), rule, verdict))
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_matches_brute_force_with_repeats_and_clashing_columns(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "y"), (None, URLS[1], "z")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(pages, rule_table(spark, RULES)).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == \
        sorted(str((i, *_expected(u))) for i, u, _ in rows)


@pytest.mark.parametrize("rules", [[], RULES])
def test_empty_table_and_no_rules(spark, rules):
    table = rule_table(spark, rules)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), table).collect() == []
    some = judge_urls(spark.createDataFrame([(1, "http://zz.org/")], "page_id long, url string"), table).collect()
    assert [(r.rule, r.verdict) for r in some] == [(None, "allow")]


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = judge_urls(pages, rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
