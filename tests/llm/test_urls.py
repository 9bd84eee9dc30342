import random
import re

from claimlake.llm.queries import URL_RULES
from claimlake.llm.url_rules import judge_urls, rule_table


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fit = [r for r in rules if r[0] and r[2] and (host == lower(r[0]) or host.endswith("." + lower(r[0]))) and path.startswith(r[1] or "")]
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1] or ""), len(r[0]), r[2] == "block"))
    return host, path, lower(best[0]) + (best[1] or ""), best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/x", "http://a.b.Example.net/en/5?q", "x://example.com/de", "x://example.com/de/", "x://y://net/",
    "http://fr.org/fr/?", "http:///en/", "http://x.net", "http://notexample.com/de/", "a\nb://net/\n/x#", "http://net#/", "http://..net/", "http://ÄÖ.org/fr/x",
    "http://x.org/" + "a/" * 2000, "http://" + "a." * 500 + "example.net/en/",
]


def compare(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(df, rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    compare(spark, URLS, URL_RULES)


def test_many_rules_and_precedence(spark):
    r = random.Random(7)
    label = lambda: r.choice(["a", "b", "cc"])
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    path = lambda: "".join(r.choice(["/", "a", "b/", "ab"]) for _ in range(r.randint(0, 4)))
    rules = {}
    for _ in range(60):  # a host and path has one action
        h, p = host(3), r.choice(["", "/" + path()])
        rules[h, p] = r.choice(["block", "allow"])
    rules = [(*k, v) for k, v in rules.items()] + [("", "/", "block"), (None, "/", "block"), ("b", None, "block")]
    rules = [x for x in rules if (x[0], x[1]) != ("b", "")]
    urls = [f"http://{host(4)}{r.choice(['', '/' + path() + path()])}{r.choice(['', '?q', '#f'])}" for _ in range(600)]
    compare(spark, urls, rules)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "http://x.net/"), (None, "http://x.net/"), (1, "http://x.net/")], "page_id long, url string")
    rules = rule_table(spark, URL_RULES)
    assert sorted(map(str, judge_urls(df, rules).collect())) == sorted(
        map(str, [("Row(page_id=%s, host='x.net', path='/', rule='net/', verdict='block')" % i) for i in (None, None, 1)])
    )
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def test_join_is_on_the_short_prefix(spark):
    """The full digest confirms candidates and is no join key; a url that comes very often has its own rows only."""
    from claimlake.llm import url_rules
    from claimlake.llm.rowkeys import kept_table

    plans = []
    real = kept_table
    url_rules.kept_table = lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label)
    try:
        pages = spark.createDataFrame([(k, "http://www.bad.net/a/b") for k in range(50)] + [(99, None), (100, "x")], "page_id long, url string")
        got = url_rules.judge_urls(pages, url_rules.rule_table(spark, [("net", "/", "block")])).collect()
    finally:
        url_rules.kept_table = real
    joins = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("short" in line and "digest" not in line for line in joins)
    assert sorted((r["rule"] or "", r["verdict"]) for r in got) == [("", "allow")] * 2 + [("net/", "block")] * 50
