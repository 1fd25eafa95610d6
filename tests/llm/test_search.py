"""Ranked search against brute force."""

import random
from collections import Counter
from math import floor, log

import pytest

from kerbline.llm.search import search_reports
from tests.llm.helpers import no_reports, odd_reports, words


def brute_force(reports, queries, k):
    bags = [(i, Counter(words(t))) for i, t in reports]
    sizes = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    n, total = len(sizes), sum(s for *_, s in sizes)
    df = Counter(t for _, bag, _ in sizes for t in bag)
    asked = {}
    for q, t in queries:
        if q is not None:
            asked.setdefault(q, Counter()).update(words(t))
    rows = set()
    for q, terms in asked.items():
        scores = []
        for i, bag, size in sizes:
            m = 25 + 75 * size * n // total
            score = sum(
                times * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t, times in terms.items()
                if bag[t]
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        rows |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_terms": 5}])
def test_reports_for_segment_names(spark, limits):
    draw = random.Random(3)
    vocabulary = [f"street{i}" for i in range(40)] + ["i", "É", "é", "Road"]
    many = [(100 + i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for i in range(300)]
    # A third of all rows is one text; other rows share its bag in another order.
    many += [(1000 - i, "Crash on Street3, street4") for i in range(150)] + [(2000 + i, "street4: crash ON street3") for i in range(30)]
    given = odd_reports(spark, many)
    asked = [(f"s{i}", " ".join(draw.choices(vocabulary, k=6))) for i in range(25)]
    asked += [("same", "Street3 street3"), ("copies", "crash ON"), ("none", "unheard"), ("empty", ""), ("null", None), (None, "road"), ("twice", "street1"), ("twice", "street2")]
    queries = spark.createDataFrame([(*a, 0, "t") for a in asked], "segment_id string, segment_name string, id int, text string")
    rows = given.select("event_id", "report").collect()
    got = {tuple(r) for r in search_reports(given, queries, **limits).collect()}
    assert got == brute_force(rows, asked, 10)
    assert [i for q, rank, i, s in sorted(got) if q == "copies"] == list(range(851, 861))
    assert {tuple(r) for r in search_reports(given, queries, k=3).collect()} == brute_force(rows, asked, 3)


def test_empty_tables(spark):
    queries = spark.createDataFrame([("a", "road")], "segment_id string, segment_name string")
    assert search_reports(no_reports(spark), queries).count() == 0
    assert search_reports(odd_reports(spark), queries.limit(0)).count() == 0
    assert search_reports(odd_reports(spark), queries).columns == ["segment_id", "rank", "event_id", "score"]


def test_keys_that_are_texts(spark):
    reports = spark.createDataFrame([(c, "lane shut") for c in ["b", "é", "a", "Z", "\U0001d504", "～"]], "event_id string, report string")
    queries = spark.createDataFrame([(1, "shut")], "segment_id long, segment_name string")
    got = search_reports(reports.union(spark.createDataFrame([("other", "clear")] * 9, reports.schema)), queries).orderBy("rank").collect()
    assert [r.event_id for r in got] == ["Z", "a", "b", "é", "～", "\U0001d504"]
