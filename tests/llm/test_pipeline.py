"""The pipeline's stages against brute force on the smallest tables and on odd documents."""

import corpus_pipeline as pipeline
from kerbline.llm.decontaminate import decontaminate
from tests.llm.helpers import words
from tests.llm.test_matching import brute_classes, brute_hits

COLUMNS = list(pipeline.DOCUMENT)


def document_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)


def test_stages_one_after_another(spark, sf_dir):
    docs = document_rows(spark, sf_dir)
    want = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
        if name == "language":
            want = {k: t for k, t in want.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            last = {}
            for k, t in want.items():
                norm = b" ".join([(t or "").encode()]).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
                last[norm] = max(k, last.get(norm, k))
            want = {k: want[k] for k in last.values()}
        elif name == "near_dedup":
            classes = brute_classes(list(want.items()), False)
            want = {k: t for k, t in want.items() if classes[k] == k}
        else:
            hit = {k for k, _, n, _ in brute_hits(list(want.items()), benchmark, 10) if n}
            want = {k: t for k, t in want.items() if k not in hit}
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert set(whole) == set(want) and all(whole[r.doc_id] == r.doc_tokens for r in packed)


def test_stages_take_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "A text without an identifier, but with words.", "en", "s", 3), (2, "", "en", None, 0), (3, "the road of the town is closed " * 4000, "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in (odd, odd.limit(0)):
        docs = extra.withColumn("size", extra.n_chars).withColumn("class_id", extra.doc_id)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == COLUMNS
            assert out.count() <= (docs.count() if name != "packing" else 10**6)
    kept = pipeline.language(spark, odd, sf_dir).collect()
    assert {r.doc_id for r in kept} == {None, 3}


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
    assert len(words("a b")) == 2 and decontaminate
