"""Corpus preparation as stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.decontaminate import decontaminate
from kerbline.llm.exactdup import exact_duplicates
from kerbline.llm.language import UNDETERMINED, identify_languages
from kerbline.llm.neardup import near_duplicates
from kerbline.llm.packing import pack_reports
from kerbline.llm.queries import held_out
from kerbline.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
# A text whose n-grams have next to nothing in common with any language is rejected as well.
LEAST_LANGUAGE_SCORE = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned stay; those without letters or language go."""
    learning = docs.where(~held_out()).select("text", "lang")
    found = identify_languages(
        docs, learning, key="doc_id", text="text", learning_text="text", language="lang", columns=DOCUMENT[1:]
    )
    spoken = (F.col("language_found") != UNDETERMINED) & (F.col("language_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(spoken).select(*DOCUMENT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays, the one with the largest identifier."""
    found = exact_duplicates(docs, key="doc_id", text="text", keep="largest", columns=DOCUMENT[1:])
    return found.where("kept").select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest identifier."""
    found = near_duplicates(docs, key="doc_id", text="text")
    goes = durable(found.where("doc_id != class_id").select("doc_id").distinct(), "near-copies")
    # Both sides grow with the documents.
    return docs.join(goes.hint("merge"), "doc_id", "left_anti").select(*DOCUMENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(
        docs, benchmark, key="doc_id", text="text", item="item_id", item_text="text", columns=DOCUMENT[1:]
    )
    return found.where("n_hit = 0").select(*DOCUMENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces of sequences of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_reports(docs, path, end_id=1, key="doc_id", text="text", sequence=2048, release=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Language profiles, darts and token identifiers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
