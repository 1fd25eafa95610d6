"""Spelling variants against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from kerbline.llm.spelling import Bloom, Filters, name_words, spelling_variants, word_keys
from tests.llm.helpers import CLASHING


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_force(counts, ratio):
    forms, rows = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if o != w and near(o, w)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (forms[w], n, len(others), counts[forms[w]] if forms[w] else None)
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows[w] = (*rows[w], root)
    return rows


def test_filter_has_every_word_and_few_others():
    words = [f"word{i:06d}" for i in range(5000)]
    bloom = Bloom.of(word_keys(words, 10))
    assert len(bloom.holds(word_keys(words, 10))) == 5000
    others = word_keys([f"none{i:06d}" for i in range(50_000)], 10)
    assert len(bloom.holds(others)) < 0.02 * len(others)


def test_edits_reach_every_near_word_from_one_side():
    words = ["aabbc", "abbc", "aabc", "zabbc", "aaébc"]
    every = {}
    for length in (4, 5):
        every[(length, 0)] = Bloom.of(word_keys([w for w in words if len(w) == length], length))
    letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    filters = Filters(every, {4: 1, 5: 1}, letters)
    found = Counter()
    for length in (4, 5):
        some = [w for w in words if len(w) == length]
        found.update((some[i], edit) for i, edit in filters.near(some, length) if edit in words)
    assert set(found.values()) == {1}
    pairs = {frozenset(p) for p in found}
    assert len(pairs) == len(found) and pairs == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


@pytest.mark.parametrize("limits", [{}, {"filter_words": 40, "filter_bytes": 256}])
def test_variants_of_segment_names(spark, limits):
    draw = random.Random(4)
    stems = ["MAPLE", "Chapel", "Élysée", "Hillsborough", "aaaaaa", "aaaaa", "road", "Üxbridge"]
    names = []
    for _ in range(1500):
        w = list(draw.choice(stems))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            i = draw.randrange(len(w))
            w[i] = draw.choice(["", w[i] + draw.choice("aeé"), draw.choice("aeoxÿ")])
        names.append("".join(w) + draw.choice([" St", "_9", "-", " (Wake)"]))
    names += ["x" * 5000] * 3 + ["x" * 4999 + "y"] * 7 + ["", "12 34"]
    rows = [(str(i), n, 0, "t", "r", 1, "k", "i", "n", 0.5, 9) for i, n in enumerate(names)]
    rows += [("n", None, 0, "t", "r", 1, "k", "i", "n", 0.5, 9), (None, "Chapel Wake", 0, "t", "r", 1, "k", "i", "n", 0.5, 9)]
    given = spark.createDataFrame(rows, f"segment_id string, segment_name string, {CLASHING}")
    import re

    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts = Counter(w for r in rows for w in re.findall("[A-Za-zÀ-ÿ]+", (r[1] or "").translate(lower)))
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling_variants(name_words(given), **limits).collect()}
    assert got == brute_force(counts, 2)
    assert any(f for f, *_ in got.values())


def test_odd_words(spark):
    rows = [(w, 1) for w in ["same", "same", "same", None, None, "", "\U0001d504" * 6, "\U0001d504" * 5 + "b"] for _ in range(3)]
    words = spark.createDataFrame(rows, "word string, n int")
    got = {r.word: (r.n, r.n_near) for r in spelling_variants(words).collect()}
    assert got == {"\U0001d504" * 6: (3, 1), "\U0001d504" * 5 + "b": (3, 1)}
    assert spelling_variants(words.limit(0)).count() == 0
    assert spelling_variants(words.where("word = 'same'")).count() == 0


def test_roots_of_long_chains(spark):
    # Counts double with each step, so every word follows the next one.
    chain = ["aaaaaaaaa"[:i] + "bbbbbbbbb"[i:] for i in range(10)]
    words = spark.createDataFrame([(w,) for i, w in enumerate(chain) for _ in range(3 * 2**i)], "word string")
    got = {r.word: (r.form, r.root) for r in spelling_variants(words).collect()}
    assert got == {w: (chain[i + 1] if i < 9 else None, chain[9]) for i, w in enumerate(chain)}
