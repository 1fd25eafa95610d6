from pyspark.sql import functions as F

from kerbline.llm.urls import UrlRule, judge_services, rule_for, url_parts
from tests.llm.helpers import CLASHING

RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
)


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q=/de/": ("a.example.net", "/en/x", "example.net/en/"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/"),
        "x://badexample.com/de/1": ("badexample.com", "/de/1", None),
        "x://www.example.com/de/1#/en/": ("www.example.com", "/de/1", "example.com/de/"),
        "http://a.net": ("a.net", "", None),
        "http://a.net?x=/y": ("a.net", "", None),
        "http://a.net/p#f?x": ("a.net", "/p", "net/"),
        "ÉCOLE://ÉX.net/a://b": ("Éx.net", "/a://b", "net/"),
        "no scheme/net/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
    }
    host, path = url_parts(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", host.alias("h"), path.alias("p"))
    for r in rows.withColumn("r", rule_for(F.col("h"), F.col("p"), RULES)).collect():
        assert (r.h, r.p, r.r and r.r.rule) == cases[r.u], r.u


def services(spark, rows):
    clash = (0, "t", "r", 1, "k", "i", "n", 0.5, 9)
    return spark.createDataFrame([(*r, *clash) for r in rows], f"layer_id long, service_url string, blocked int, {CLASHING}")


def test_trees_learn_spelling(spark):
    good = [(i, f"https://maps{i % 40}.example.gov/rest/layer/{i}", 0) for i in range(300)]
    bad = [(1000 + i, f"http://x{i * 7919 % 99991}-{i}.example.biz/?a={i}&b={i}&c=1&d=2&e={i * 31}", 1) for i in range(120)]
    labelled = services(spark, [r for r in good + bad if r[0] % 5])
    rows = judge_services(services(spark, good + bad), labelled, ()).collect()
    held = [r for r in rows if r.layer_id % 5 == 0]
    assert all(0 <= r.block_score <= 1 for r in rows)
    assert sum((r.verdict == "block") == (r.layer_id >= 1000) for r in held) >= 0.95 * len(held)


def test_suffixes_are_counted_over_all_labelled_addresses(spark):
    # Only the suffix tells the label, and few of the labelled addresses are drawn for the trees.
    bad = lambda k: k * 7919 % 97 % 2
    every = [(i, f"http://h{i % 20}.s{1000 + i // 20}.biz/p/{10000 + i}", bad(i // 20)) for i in range(6000)]
    labelled = services(spark, [r for r in every if r[0] % 5])
    rows = judge_services(services(spark, every), labelled, (), rows=400).collect()
    held = [r for r in rows if r.layer_id % 5 == 0]
    assert sum((r.verdict == "block") == bad(r.layer_id // 20) for r in held) >= 0.97 * len(held)


def test_odd_services(spark):
    given = services(spark, [(1, None, 1), (1, None, 1), (None, "http://a.net/", 0), (2, "", None), (3, "u://h/" + "a?" * 30_000, 0)])
    rows = judge_services(given, given.limit(0), RULES).collect()
    assert len(rows) == 5 and {r.verdict for r in rows if r.layer_id is not None} == {"allow"}
    assert [(r.rule, r.verdict, r.block_score) for r in rows if r.layer_id is None] == [("net/", "block", None)]
    only = judge_services(given, services(spark, [(1, "http://x.org/", 1)]), RULES).collect()
    assert {r.verdict for r in only} == {"block"}
    assert judge_services(given.limit(0), given, RULES).count() == 0
