"""Language of incident reports by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.workers import ship_package

UNDETERMINED = "und"
# n-grams in a profile, and the longest of them.
PROFILE = 300
# Texts whose n-grams are merged at once, and n-grams a task holds before it hands counts on.
MERGED_TEXTS = 512
HELD_GRAMS = 1_000_000

# Stands for everything between two words; above every character.
_GAP = 0x110000
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each character's own number if it is a letter, else the gap."""
    table = np.full(_GAP, _GAP, np.int64)
    which = np.fromiter((i for i in range(_GAP) if chr(i).isalpha()), np.int64)
    table[which] = which
    return table


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (1 to 3 letters, gaps at word borders) of a whole text and their counts, in code order."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = codes == _GAP
    kept = np.ones(len(codes), bool)
    kept[1:] = ~(gap[1:] & gap[:-1])
    codes = np.concatenate([[_GAP], codes[kept], [_GAP]])
    if codes[1] == _GAP:
        codes = codes[1:]
    if len(codes) > 1 and codes[-2] == _GAP:
        codes = codes[:-1]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = (codes[:-1] << _BITS) | codes[1:]
    middle = codes[1:-1] != _GAP
    triples = ((pairs[:-1] << _BITS) | codes[2:])[middle]
    every = np.sort(np.concatenate([codes[codes != _GAP], pairs, triples]))
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[new], np.diff(np.append(new, len(every)))


def _ranked(text: str, size: int) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first; equal counts in code order."""
    codes, counts = _grams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Per language the ranks of its n-grams; ``ranks`` holds ``size`` where a language lacks one."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From (language, rank, code)."""
        languages = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[2] for r in rows], np.int64))
        ranks = np.full((len(codes) + 1, len(languages)), size, np.int64)
        for language, rank, code in rows:
            ranks[np.searchsorted(codes, code), languages.index(language)] = rank
        return Profiles(languages, codes, ranks, size)

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance, and 1 - distance / largest possible."""
        ranked = _ranked(text, self.size) if text else np.zeros(0, np.int64)
        if not len(ranked) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, ranked)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != ranked)] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(ranked))[:, None]))
        distance = apart.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(ranked)))


def language_profiles(
    learning: DataFrame, text: str = "report", language: str = "language", size: int = PROFILE
) -> DataFrame:
    """(language, rank, code): the most frequent n-grams of all learning texts of each language."""
    ship_package(learning.sparkSession)
    known = learning.select(F.col(language).alias("language"), F.col(text).alias("text")).dropna()

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([k for _, k in found])).astype(np.int64)

    def handed(counts: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
        for name, (codes, n) in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())],
                ["language", "code", "n"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple] = {}
        for whole in batches:
            for batch in (whole.slice(i, MERGED_TEXTS) for i in range(0, whole.num_rows, MERGED_TEXTS)):
                held: dict[str, list] = {}
                for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(name, []).append(_grams(t))
                for name, found in held.items():
                    counts[name] = merged([*found, counts[name]] if name in counts else found)
                if sum(len(codes) for codes, _ in counts.values()) > HELD_GRAMS:
                    yield from handed(counts)
                    counts = {}
        yield from handed(counts)

    counts = (
        known.mapInArrow(count, "language string, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n"))
    )
    # The window keeps the first rows of each language only, before and after the shuffle.
    order = Window.partitionBy("language").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return ranked.select("language", "rank", "code")


def identify_languages(
    reports: DataFrame,
    learning: DataFrame,
    key: str = "event_id",
    text: str = "report",
    learning_text: str = "report",
    language: str = "language",
    size: int = PROFILE,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """The language of each whole report, out of those in ``learning``.

    Method: rank-order profiles. A profile lists the ``size`` most frequent
    n-grams (one to three letters, word borders included, lower-cased); a
    report's list is compared with each language's by the sum of the places its
    n-grams are out of, ``size`` for a missing one. Profiles are counted over
    all learning texts, so a language of few rows has its profile at any size.

    Returns per input row: ``key``, ``columns``, language_found, language_score (1: same list,
    0: nothing in common). The profiles (``size`` rows per language) are the only
    thing that goes to every task.

    Edge cases: ``und`` with score 0 for a null text, one without a letter, or
    if nothing could be learned. Equal distances: the language first in the
    alphabet. Learning rows without text or language are left out. Null and
    repeated keys are kept as they are. Other columns are ignored unless named in
    ``columns``.
    """
    spark = reports.sparkSession
    ship_package(spark)
    learned = [(r["language"], r["rank"], r["code"]) for r in language_profiles(learning, learning_text, language, size).collect()]
    profiles = spark.sparkContext.broadcast(Profiles.of(learned, size))
    rest = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns) if c != text]
    rows_in = reports.select(F.col(text).alias("_text"), F.col(key).alias("_key"), *rest)
    kept = rows_in.schema.fields[0 if text in columns else 1 :]
    schema = rows_in.schema.__class__(list(kept)).add("_language", "string").add("_score", "double")
    first = 0 if text in columns else 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = profiles.value.nearest
        for batch in batches:
            found = [nearest(t.as_py()) for t in batch.column(0)]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[first:], names, scores], [*batch.schema.names[first:], "_language", "_score"]
            )

    judged = rows_in.mapInArrow(judge, schema)
    return judged.select(
        F.col("_key").alias(key),
        *[F.col("_text" if c == text else f"_{i}").alias(c) for i, c in enumerate(columns)],
        F.col("_language").alias("language_found"), F.col("_score").alias("language_score")
    )
