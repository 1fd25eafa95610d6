"""Language and toxicity: accuracy on rows that were not learned from, and exact neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm.language import _grams, identify_languages, language_profiles
from kerbline.llm.queries import held_out, op8_toxicity, op9_language
from kerbline.llm.records import live_reports
from kerbline.llm.toxicity import BlockMaxIndex, score_toxicity
from tests.conftest import TESTDATA
from tests.llm.helpers import no_reports, odd_reports, words


def test_grams_of_a_whole_text():
    codes, counts = _grams("Ab, ab")
    gap, bits = 0x110000, 21
    a, b = ord("a"), ord("b")
    want = {a: 2, b: 2, gap << bits | a: 2, a << bits | b: 2, b << bits | gap: 2}
    want |= {(gap << bits | a) << bits | b: 2, (a << bits | b) << bits | gap: 2}
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want
    assert len(_grams("12 !")[0]) == len(_grams("")[0]) == 0


def test_languages_of_held_out_documents(spark):
    path = f"{TESTDATA}/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op9_language(spark, path).collect() if r.held_out]
    assert len(rows) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_language_is_the_least_out_of_place_distance(spark):
    draw = random.Random(8)
    size = 20
    alphabets = {"a1": "abcdé", "b2": "cdefg", "c3": "efghß"}
    line = lambda letters: " ".join("".join(draw.choices(letters, k=draw.randint(1, 6))) for _ in range(draw.randint(1, 8)))
    learning = [(line(letters), name) for name, letters in alphabets.items() for _ in range(12)]
    texts = [line("abcdefghéß") for _ in range(60)] + ["", "7 !", None, "Ab, ab; É"]

    def counted(text):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = [f" {w} " for w in kept]
        # One run of n-grams over the text, a gap between words counted once in pairs at each side.
        grams = Counter(c for w in kept for c in w)
        for w in padded:
            grams.update(w[i : i + 2] for i in range(len(w) - 1))
            grams.update(w[i : i + 3] for i in range(len(w) - 2))
        return grams

    code = lambda gram: tuple(0x110000 if c == " " else ord(c) for c in gram)

    def ranked(grams):
        # Equal counts by code: shorter n-grams have the smaller numbers.
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], len(x[0]), code(x[0])))][:size]

    profiles = {name: ranked(sum((counted(t) for t, n in learning if n == name), Counter())) for name in alphabets}
    given = spark.createDataFrame(list(enumerate(texts)), "event_id long, report string")
    known = spark.createDataFrame(learning, "report string, language string")
    for r in identify_languages(given, known, size=size).collect():
        own = ranked(counted(texts[r.event_id]))
        if not own:
            assert (r.language_found, r.language_score) == ("und", 0.0)
            continue
        far = {n: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for n, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.language_found == best and abs(r.language_score - (1 - far[best] / (size * len(own)))) < 1e-12


def test_language_of_odd_reports(spark):
    learning = spark.createDataFrame(
        [("the road is closed near the bridge", "en"), ("die straße ist an der brücke gesperrt", "de"), (None, "fr"), ("x", None)],
        "report string, language string",
    )
    got = {}
    for r in identify_languages(odd_reports(spark), learning, columns=("row", "report", "id")).collect():
        got[r.event_id] = (r.language_found, r.language_score)
        assert (r.row, r.id) == ("r", 0) and (r.event_id != 1 or r.report.startswith("Road closed"))
    assert got[3] == got[4] == got[6] == ("und", 0.0) and got[1][0] == "en"
    assert {r.language_found for r in identify_languages(odd_reports(spark), learning.limit(0)).collect()} == {"und"}
    assert identify_languages(no_reports(spark), learning).count() == 0


def test_a_rare_language_is_learned_from_all_its_texts(spark):
    # Of 300,000 learning texts a third is one text, and three are of a language of their own.
    learning = spark.range(300_000).select(
        F.when(F.col("id") < 3, F.concat(F.lit("die straße ist an der brücke gesperrt "), F.col("id")))
        .when(F.col("id") < 100_000, "the road is closed near the bridge")
        .otherwise(F.concat(F.lit("a lane is shut at exit "), F.col("id")))
        .alias("report"),
        F.when(F.col("id") < 3, "de").otherwise("en").alias("language"),
    )
    given = spark.createDataFrame([(1, "die brücke ist gesperrt"), (2, "the lane is closed")], "event_id long, report string")
    assert {r.event_id: r.language_found for r in identify_languages(given, learning).collect()} == {1: "de", 2: "en"}
    profiles = language_profiles(learning).groupBy("language").count().collect()
    assert {r.language for r in profiles} == {"de", "en"}


def test_search_is_exact():
    rng = np.random.default_rng(2)
    dense = (rng.random((700, 30)) < 0.15) * rng.random((700, 30))
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
    index = BlockMaxIndex(vectors, rng.integers(0, 2, 700), [str(i) for i in range(700)], 30)
    for v in dense[:60]:
        term = np.flatnonzero(v)
        if not len(term):
            continue
        _, cosine = index.search(term, v[term], 9)
        every = np.sort(np.unique(dense, axis=0) @ v)[::-1][:9]
        assert np.allclose(cosine, every)


def test_toxicity_of_held_out_documents(spark):
    path = f"{TESTDATA}/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in op8_toxicity(spark, path).where(F.col("held_out")).collect() if r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    caught = sum(r.predicted for r in rows if truth[r.doc_id])
    assert right >= 0.97 * len(rows) and caught >= 0.9 * sum(truth[r.doc_id] for r in rows)
    brier = sum((r.score - truth[r.doc_id]) ** 2 for r in rows) / len(rows)
    assert brier < 0.03


def test_a_copy_of_an_example_of_rare_words_is_found(spark):
    rare = [(1000 + i, f"uncommon{i} seldom{i} scarce{i}") for i in range(60)]
    given = spark.createDataFrame(rare + [(i, f"lane closed at exit {i}") for i in range(300)], "event_id long, report string")
    labelled = given.withColumn("toxic", (F.col("event_id") >= 1000).cast("int"))
    for r in score_toxicity(given, labelled).where("event_id >= 1000").collect():
        assert r.evidence[0].example == str(r.event_id) and r.evidence[0].cosine > 1 - 1e-9
        assert r.score > 0.9


def test_whole_scores_equal_brute_force(spark):
    draw = random.Random(6)
    common, bad = [f"w{i}" for i in range(60)], ["clown", "fool", "pest"]
    rows = []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join(draw.choices(common, k=draw.randint(0, 12)) + (draw.sample(bad, 2) if toxic and i % 3 else [])), int(toxic)))
    given = spark.createDataFrame(rows, "event_id long, report string, toxic int")
    labelled = given.where("event_id % 2 = 0")
    got = {r.event_id: r.score for r in score_toxicity(given, labelled).collect()}
    learn = [r for r in rows if r[0] % 2 == 0]
    bags = {i: Counter(words(t)) for i, t, _ in rows}
    known = {t for i, _, _ in learn for t in bags[i]}
    n, b = len(learn), sum(y for *_, y in learn)
    weight = {}
    for t in known:
        held = [y for i, _, y in learn if t in bags[i]]
        k, x = len(held), sum(held)
        chi = (x * n - k * b) ** 2 * n / (b * (n - b) * k * (n - k)) if k < n else 0
        df = sum(t in bag for bag in bags.values())
        weight[t] = (math.log((1 + len(rows)) / (1 + df)) + 1e-3) * (1 if chi >= 30 and k >= 5 else 0.1)
    vectors = {}
    for i, bag in bags.items():
        v = {t: (1 + math.log(c)) * weight[t] for t, c in bag.items() if t in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    entries = {}
    for i, _, y in learn:
        if vectors[i]:
            key = tuple(sorted((t, round(x, 12)) for t, x in vectors[i].items()))
            entry = entries.setdefault(key, [vectors[i], 0, 0])
            entry[1] += 1
            entry[2] += y
    none = [y for i, _, y in learn if not vectors[i]]
    for i, v in vectors.items():
        if not v:
            assert got[i] == pytest.approx((sum(none) + b / n) / (len(none) + 1))
            continue
        cosines = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), m, y) for e, m, y in entries.values()), reverse=True)
        if round(cosines[14][0], 9) == round(cosines[15][0], 9):
            continue  # a tie about the last neighbour
        near = [(min(c, 1.0) / (1.05 - min(c, 1.0)), m, y) for c, m, y in cosines[:15] if c > 0]
        assert got[i] == pytest.approx((sum(c * y for c, _, y in near) + b / n) / (sum(c * m for c, m, _ in near) + 1))


def test_toxicity_of_odd_reports(spark):
    bad = [(100 + i, f"you absolute clown {i} of a road") for i in range(40)]
    good = [(200 + i, f"quiet lane {i} of a road") for i in range(160)]
    given = odd_reports(spark, bad + good)
    labelled = given.withColumn("toxic", F.when(F.col("event_id") >= 100, (F.col("event_id") < 200).cast("int")))
    rows = {r.event_id: r for r in score_toxicity(given, labelled).collect()}
    assert all(rows[k].predicted == 1 and rows[k].evidence[0].share > 0.9 for k, _ in bad)
    assert all(rows[k].predicted == 0 for k, _ in good)
    assert rows[3].score == rows[4].score and not rows[3].evidence
    assert {r.score for r in score_toxicity(given, labelled.limit(0)).collect()} == {0.0}
    assert score_toxicity(no_reports(spark), labelled).count() == 0


def test_reports_of_live_incidents(spark):
    live = spark.createDataFrame([(1, "I-40", None, "closed"), (2, None, None, None)], "event_id long, Road string, Reason string, Condition string")
    assert [tuple(r) for r in live_reports(live).orderBy("event_id").collect()] == [(1, "I-40. closed"), (2, None)]


def test_held_out_rows(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
