import re

from pyspark.sql import functions as F

from marketloom.llm import url_filter
from marketloom.llm.queries import URL_RULES
from marketloom.llm.url_filter import Rule


def located(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):])[0]


def by_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


URLS = [None, "", "abc", "HTTP://ÀB.Org:80/p", "x://a.ORG/?q#f", "x://org", "x://org/", "x://y.com/de/é\nz", "x://" + "9" * 20_000, "a://b://org/", "x://corg/", "h://EXAMPLE.org/en/12", "h://s.example.org/es/?a=1&b=2",
        "h://x.com/fr/#de", "h://x.com/fr", "h://x.com#/de/", "h://net.example.net/en/5?x=%20"] + [f"h://s{i % 7}.example.{t}/{l}/{i}" for i in range(60) for t in ("org", "com", "net") for l in ("de", "fr", "es", "en")]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id bigint, url string, host string").repartition(3)
    out = {r.page_id: r for r in url_filter.judge(df, URL_RULES).collect()}
    assert len(out) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = located(url)
        rule = by_rule(host, path, URL_RULES)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
        assert 0 <= r.score <= 1
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_the_trees_learn_what_the_rules_say(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS[17:])] * 2, "page_id bigint, url string")
    known = [r for r in url_filter.judge(df, URL_RULES).collect() if r.rule]
    assert len(known) > 200
    assert sum((r.score >= 0.5) == (r.verdict == "block") for r in known) / len(known) > 0.9


def test_one_kind_of_label_and_none(spark):
    df = spark.createDataFrame([(1, "h://a.org/x"), (2, "h://b.net/y"), (None, None)], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judge(df, [Rule("block", "org", "/")]).collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge(df, [Rule("block", "none", "/")]).collect()} == {"allow"}


def test_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("",), ("abcd",), ("....",)], "t string").select(url_filter.entropy(F.col("t")).alias("e")).collect()
    assert [round(r.e, 9) for r in rows] == [1.0, 0.0, 2.0, 0.0]
