"""Exact and near duplicates and held-out passages against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.decontaminate import decontaminate
from kerbline.llm.exactdup import exact_duplicates
from kerbline.llm.neardup import (
    _by_rare_shingles,
    _cell_counts,
    _meetings,
    _prefixes,
    _shingle_sets,
    dart_sketches,
    near_duplicates,
)
from kerbline.llm.words import chunks, mixed, words_of
from kerbline.session import durable
from tests.llm.helpers import no_reports, odd_reports, words


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("range_bytes", [1 << 30, 2000, 100])
def test_exact_duplicates(spark, keep, range_bytes):
    draw = random.Random(1)
    header = "Same header " + "x" * 60
    many = [(50 + i, draw.choice([header + str(draw.randint(0, 20)), "aBc", "É", "é", "hot text"])) for i in range(400)]
    given = odd_reports(spark, many)
    rows = exact_duplicates(given, keep=keep, range_bytes=range_bytes, columns=("report", "row")).collect()
    assert len(rows) == given.count()
    groups = defaultdict(list)
    for r in rows:
        groups[(r.report or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))].append(r)
    for text, group in groups.items():
        ids = [r.event_id for r in group if r.event_id is not None]
        stays = ((min if keep == "smallest" else max)(ids)) if ids else None
        assert all((r.keep_id, r.group_size) == (stays, len(group)) for r in group)
        assert [r.event_id for r in group if r.kept] == [stays]
        assert {r.text_sha256 for r in group} == {hashlib.sha256(text).hexdigest()}
    assert exact_duplicates(no_reports(spark)).count() == 0


def test_words_are_those_of_the_pattern():
    texts = ["Ab c_d9", None, "", "é-É ß", "x", "y" * 50, " end ", "日本 語"]
    seen = {}
    for begin, to, data, offsets in chunks(pa.array(texts), 16):
        found = words_of(data, offsets)
        for i in range(begin, to):
            keys = found.keys[found.first[i - begin] : found.first[i - begin + 1]].tolist()
            want = words(texts[i])
            assert len(keys) == len(want)
            for k, w in zip(keys, want, strict=True):
                assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


def test_sketches_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    keys = mixed(np.arange(120, dtype=np.uint64))
    a, b = rng.random(120) * 3, rng.random(120) * 3
    b[:60] = a[:60]
    sketch = dart_sketches(np.concatenate([keys, keys]), np.concatenate([a, b]), np.repeat([0, 1], 120), 3, 1024)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sketch[0] == sketch[1]).mean() - true) < 0.06
    assert np.isinf(sketch[2]).all() and np.isfinite(sketch[:2]).all()


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randint(200, 300), draw.randint(200, 300)) for _ in range(60)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for u, v in edges if u != v for x in (u, v)}


def brute_classes(rows, counted):
    sets = {}
    for key, text in rows:
        w, n = words(text), defaultdict(int)
        for j in range(max(1, len(w) - 4) if w else 0):
            n[tuple(w[j : j + 5])] += 1
        sets[key] = {(s, i) for s, times in n.items() for i in range(times if counted else 1)}
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("counted", [False, True])
def test_near_duplicates(spark, counted):
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(90):  # one large group of near copies, in steps
        if i % 9 == 0:
            base[draw.randrange(120)] = f"v{i}"
        copy = list(base)
        for _ in range(draw.randint(0, 2)):
            copy[draw.randrange(120)] = f"u{draw.randint(0, 5)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i, " ".join(f"z{draw.randint(0, 300)}" for _ in range(40))) for i in range(20)]
    rows += [(400, "only four words here"), (401, "Only FOUR words, here!"), (402, "line one two three four five " * 20)]
    got = {}
    for r in near_duplicates(odd_reports(spark, rows), counted=counted).collect():
        got.setdefault(r.event_id, set()).add(r.class_id)
    want = brute_classes(rows, counted)
    assert {k: got[k] for k in want} == {k: {v} for k, v in want.items()}
    assert got[1] == got[2] == {1} and got[3] == {3} and got[4] == {4} and got[None] == {None}


def test_near_pairs_in_a_family_on_one_template(spark):
    # Two texts of a pair are at 201 / 251, two of different pairs at 200 / 252.
    template = " ".join(f"t{i}" for i in range(204))
    rows = [(i, f"{template} p{i // 2} " + " ".join(f"u{i}x{j}" for j in range(25))) for i in range(3000)]
    given = spark.createDataFrame(rows, "event_id long, report string")
    few = rows[:60] + rows[-60:]
    assert brute_classes(few, False) == {i: i - i % 2 for i, _ in few}
    got = {r.event_id: (r.class_id, r.class_size) for r in near_duplicates(given).collect()}
    assert got == {i: (i - i % 2, 2) for i, _ in rows}


def family(n):
    # 204 common and 31 own words each: 0.76, no pair.
    common = " ".join(f"t{i}" for i in range(204))
    return [(i, f"{common} " + " ".join(f"u{i}x{j}" for j in range(31))) for i in range(n)]


def test_candidates_of_a_template_family_grow_with_it(spark):
    met = {}
    for n in (200, 400):
        given = spark.createDataFrame(family(n), "id long, report string")
        sets = _shingle_sets(given, False).withColumn("class", F.col("id"))
        rows = _prefixes(sets, _cell_counts(sets), 0.8)
        met[n] = _meetings(rows, 0.8).count()
    assert met[400] <= 2 * met[200] + 100 and met[400] < 400


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_shingles_find_every_similar_pair(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        base = [draw.choice(words) for _ in range(draw.randint(8, 90))]
        for j in range(6):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((10 * i + j, " ".join(copy[: len(copy) - draw.randint(0, 3)])))
    given = spark.createDataFrame(rows, "id long, report string")
    sets = durable(_shingle_sets(given, False).withColumn("class", F.when(F.col("id") % 10 < 2, 0).otherwise(F.col("id"))), "sets")
    got = {(r.a, r.b) for r in _by_rare_shingles(sets, sets, 0.8).collect()}
    held = {r.id: (r["class"], set(r.set)) for r in sets.collect()}
    similar = set()
    for (a, (c, x)), (b, (d, y)) in combinations(sorted(held.items()), 2):
        common = len(x & y)
        if c != d and 5 * common >= 4 * (len(x) + len(y) - common):
            similar.add((a, b))
    assert similar and similar <= got


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(no_reports(spark)).count() == 0


def brute_hits(reports, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n and item is not None else ():
            windows[tuple(w[j : j + n])].add(str(item))
    out = []
    for key, text in reports:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    draw = random.Random(7)
    line = lambda n: " ".join(draw.choice("abcdef") + draw.choice("xy") for _ in range(n))
    items = [(i, line(draw.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, ""), (None, "ax"), (92, "!!")]
    reports = [(100 + i, line(60)) for i in range(30)]
    reports += [(200 + i, f"{line(5)} {text.upper() if text else ''}, {line(3)}") for i, (_, text) in enumerate(items)]
    given = odd_reports(spark, reports)
    held = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, row int")
    rows = decontaminate(given, held, block_bytes=block_bytes, columns=("report", "row", "id")).collect()
    assert sorted((r.event_id or 0, r.report or "", r.row, r.id) for r in rows) == sorted((r.event_id or 0, r.report or "", "r", 0) for r in given.collect())
    got = sorted(((r.event_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str)
    assert got == brute_hits([(r.event_id, r.report) for r in given.collect()], items, 10)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)
    assert decontaminate(no_reports(spark), held).count() == 0
    assert {r.n_hit for r in decontaminate(given, held.limit(0)).collect()} == {0}
