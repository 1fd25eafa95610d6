"""Spelling variants among the words of segment names, found by edits that pass a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.records import lower_ascii
from kerbline.llm.words import mixed, powers
from kerbline.llm.workers import ship_package
from kerbline.session import durable

# Letters of words: a-z and the Latin-1 letters, among them the signs of times and division.
LETTERS = "[a-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
# Words of one filter, and bytes of filters that are broadcast at once.
FILTER_WORDS = 1 << 20
FILTER_BYTES = 1 << 25
# A block of the filter is 8 numbers of 64 bits, one bit in each per word; 16 bits a word.
_BLOCK = 8
_BLOCK_WORDS = 32
_SALTS = np.array(
    [0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31,
     0x5DA7C8C3A8AD9A3B, 0xB45E2F9FC2A4E6C7, 0x2F0B4B7D3C1A9E55, 0xC2B2AE3D27D4EB4F], np.uint64
)
_BASE = 0xD1342543DE82EF95
# Edits made at once in a task.
EDITS = 1 << 20


def name_words(records: DataFrame, key: str = "segment_id", text: str = "segment_name") -> DataFrame:
    """(key, word): the maximal runs of Latin letters of each text, A-Z lower-cased, one row per occurrence.

    A null text has none.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))
    return records.select(F.col(key), F.explode(runs).alias("word"))


class Bloom:
    """A blocked filter: a word sets or asks 8 bits in one line of memory."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.reshape(-1, _BLOCK)

    @classmethod
    def of(cls, keys: np.ndarray) -> Bloom:
        made = cls(np.zeros(_BLOCK * max(1, ceil(len(keys) / _BLOCK_WORDS)), np.uint64))
        block = made._block(keys)
        for j in range(_BLOCK):
            np.bitwise_or.at(made.bits, (block, j), np.uint64(1) << _bit(keys, j))
        return made

    def _block(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(len(self.bits))).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the filter; every key that is in it is among them."""
        left, block = np.arange(len(keys)), self._block(keys)
        for j in range(_BLOCK):
            hit = (self.bits[block, j] >> _bit(keys, j)) & np.uint64(1) == 1
            left, block, keys = left[hit], block[hit], keys[hit]
        return left


def _bit(keys: np.ndarray, j: int) -> np.ndarray:
    return (keys * _SALTS[j]) >> np.uint64(58)


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The filter a key belongs to, among those of its length."""
    return ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code point times base**place before each place; of the whole word in the last column."""
    up, _ = powers(_BASE, codes.shape[1] + 1)
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:-1], axis=1, out=sums[:, 1:])
    return sums, up


def word_keys(words: list[str], length: int) -> np.ndarray:
    return mixed(_sums(_code_points(words, length))[0][:, -1])


def _by_length(words: list[str]) -> dict[int, list[int]]:
    of: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        of.setdefault(len(word), []).append(i)
    return of


@dataclass
class Filters:
    """Filters of one pass by (length, part), how many parts each length has, and the letters in use."""

    held: dict[tuple[int, int], Bloom]
    parts: dict[int, int]
    letters: np.ndarray

    def _pass(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Places of keys of words of this length that a filter of this pass lets through."""
        n, found = self.parts.get(length, 0), []
        part = _parts(keys, n) if n > 1 else None
        for p in range(n):
            if bloom := self.held.get((length, p)):
                asked = np.flatnonzero(part == p) if n > 1 else None
                hit = bloom.holds(keys if asked is None else keys[asked])
                found.append(hit if asked is None else asked[hit])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def near(self, words: list[str], length: int) -> Iterator[tuple[int, str]]:
        """(place in ``words``, edit): edits that may be words.

        A word is shortened by one letter or gets one letter exchanged for a later
        one; every pair of near words has one side from which the other is reached so.
        """
        at_once = max(1, EDITS // max(1, length))
        for begin in range(0, len(words), at_once):
            some = words[begin : begin + at_once]
            codes = _code_points(some, length)
            sums, up = _sums(codes)
            if any(k[0] == length - 1 for k in self.held):
                down = powers(_BASE, 2)[1][1]
                keys = mixed(sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * down)
                # Of equal letters side by side, taking any one away gives the same word.
                fresh = np.ones(codes.shape, bool)
                fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
                at = np.flatnonzero(fresh.reshape(-1))
                for k in at[self._pass(length - 1, keys.reshape(-1)[at])].tolist():
                    i, j = divmod(k, length)
                    yield begin + i, some[i][:j] + some[i][j + 1 :]
            if any(k[0] == length for k in self.held):
                for letter in self.letters.tolist():
                    at = np.flatnonzero(codes.reshape(-1) < letter)
                    i, j = np.divmod(at, length)
                    keys = mixed(sums[i, -1] + (np.uint64(letter) - codes.reshape(-1)[at]) * up[j])
                    for k in self._pass(length, keys).tolist():
                        w, place = some[i[k]], int(j[k])
                        yield begin + int(i[k]), w[:place] + chr(letter) + w[place + 1 :]


def spelling_variants(
    words: DataFrame,
    word: str = "word",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    filter_words: int = FILTER_WORDS,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Groups the spelling variants among words that occur in segment names.

    ``words`` has one row per occurrence (see ``name_words``). The vocabulary are
    words of at least ``min_chars`` code points and ``min_count`` occurrences. Two
    words are near if exactly one code point is inserted, deleted or replaced
    between them. A word's form is its near word that occurs most (ties: smallest
    in code-point order), if that occurs at least ``ratio`` times as often.

    Method: blocked Bloom filters over the vocabulary, one or more per word
    length, are built on Spark and broadcast, ``filter_bytes`` of them at a time
    (a larger vocabulary takes more passes over itself). Tasks make the edits of
    each word and ask the filters; edits that pass are joined with the vocabulary,
    which removes the false ones.

    Returns per word: word, form, root (from the word along forms to the last; the
    word itself without a form), n, n_near (number of near words), form_n.

    Edge cases: nulls and words that are too short or too rare are not in the
    result; words of any length and any letters are handled. An empty table gives
    an empty result. Other columns are ignored.
    """
    if min_chars < 1 or ratio < 2:
        raise ValueError("min_chars is at least 1, ratio at least 2")
    spark = words.sparkSession
    ship_package(spark)
    vocabulary = durable(
        words.select(F.col(word).alias("word"))
        .where(F.char_length("word") >= min_chars)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count),
        "vocabulary",
    )
    pairs = _near_words(vocabulary, filter_words, filter_bytes)
    if pairs is None:
        return vocabulary.select("word", *_no_form())
    # Exact: an edit that is no word goes.
    met = durable(
        pairs.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"), "near-words"
    )
    both = met.select("word", "n", "near", "near_n").unionByName(
        met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"), F.col("n").alias("n"))).alias("best"),
    )
    best = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"), F.col("best.n").alias("n"))
    follows = F.col("form_n") >= ratio * F.col("n")
    best = durable(
        best.select("word", "n_near", F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")),
        "forms",
    )
    # All sides grow with the vocabulary.
    found = vocabulary.join(best, "word", "left").join(_roots(best), "word", "left")
    return found.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )


def _no_form() -> list:
    null = F.lit(None)
    return [
        null.cast("string").alias("form"), F.col("word").alias("root"), F.col("n"),
        F.lit(0).cast("long").alias("n_near"), null.cast("long").alias("form_n"),
    ]


def _near_words(vocabulary: DataFrame, filter_words: int, filter_bytes: int) -> DataFrame | None:
    """(word, n, near): edits that passed a filter; None without words."""
    # One row per length, and at most one per letter there is.
    lengths = vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not lengths:
        return None
    letters = vocabulary.select("word").mapInArrow(_letters, "letter int").distinct().collect()
    letters = np.array(sorted(r["letter"] for r in letters), np.uint64)
    parts = {r["length"]: ceil(r["n"] / filter_words) for r in lengths}
    filters = durable(_filters(vocabulary, parts), "filters")
    # Runs of filters of bounded size, by their order.
    sizes = filters.select("length", "part", F.octet_length("bits").alias("size")).orderBy("length", "part").toLocalIterator()
    passes, room = [], 0
    for r in sizes:
        if not passes or r["size"] > room:
            passes.append([])
            room = filter_bytes
        passes[-1].append((r["length"], r["part"]))
        room -= r["size"]
    found = None
    for keys in passes:
        low, high = keys[0], keys[-1]
        here = F.struct("length", "part")
        chosen = filters.where((here >= _pair(low)) & (here <= _pair(high))).collect()
        held = Filters(
            {(r["length"], r["part"]): Bloom(np.frombuffer(r["bits"], np.uint64)) for r in chosen}, parts, letters
        )
        asking = vocabulary.where(F.char_length("word").between(low[0], high[0] + 1))
        more = durable(_edits(asking, held), "edits")
        found = more if found is None else found.unionByName(more)
    return found


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The code points in use."""
    seen: set[str] = set()
    for batch in batches:
        seen.update(*batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(sorted(map(ord, seen)), pa.int32())], ["letter"])


def _pair(key: tuple[int, int]):
    return F.struct(F.lit(key[0]).alias("length"), F.lit(key[1]).alias("part"))


def _filters(vocabulary: DataFrame, parts: dict[int, int]) -> DataFrame:
    """(length, part, bits); a filter is built in one task from at most about ``FILTER_WORDS`` keys."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, of in _by_length(words).items():
                keys = word_keys([words[i] for i in of], length)
                part = _parts(keys, parts[length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of), length, np.int32)), pa.array(part.astype(np.int32)), pa.array(keys.view(np.int64))],
                    ["length", "part", "key"],
                )

    def build(rows: pa.Table) -> pa.Table:
        bits = Bloom.of(rows.column("key").to_numpy().view(np.uint64)).bits
        return pa.table({"length": rows.column("length")[:1], "part": rows.column("part")[:1], "bits": pa.array([bits.tobytes()])})

    keyed = vocabulary.select("word").mapInArrow(key, "length int, part int, key long")
    return keyed.groupBy("length", "part").applyInArrow(build, "length int, part int, bits binary")


def _edits(asking: DataFrame, filters: Filters) -> DataFrame:
    held = asking.sparkSession.sparkContext.broadcast(filters)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for length, of in _by_length(words).items():
                for k, near in held.value.near([words[i] for i in of], length):
                    for column, value in zip(out, (words[of[k]], n[of[k]], near), strict=True):
                        column.append(value)
                    if len(out[0]) >= 10_000:
                        yield _edit_rows(out)
                        out = ([], [], [])
            yield _edit_rows(out)

    return asking.select("word", "n").mapInArrow(edit, "word string, n long, near string")


def _edit_rows(out: tuple[list, list, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["word", "n", "near"])


def _roots(best: DataFrame) -> DataFrame:
    """(word, root) of the words with a form; steps double each round, and counts double each step."""
    held = best.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        beyond = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        held = durable(
            held.join(beyond, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if held.where("moved").isEmpty():
            return held.select("word", "root")
