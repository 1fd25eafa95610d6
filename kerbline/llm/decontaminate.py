"""Passages of held-out reports inside incident reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.words import Words, chunks, words_of
from kerbline.llm.workers import ship_package
from kerbline.session import durable

WINDOW_WORDS = 10
# A shingle of the join; windows of fewer words have shorter ones.
SHINGLE_WORDS = 2
# Text bytes of held-out items that one pass takes along; more items mean more passes.
BLOCK_BYTES = 1 << 20


def _shingle_length(window: int) -> int:
    return min(SHINGLE_WORDS, window)


@dataclass
class Windows:
    """The distinct windows of some items: word keys and lengths, and which items have each.

    ``prefix_key`` is a window's rarest shingle and ``prefix_at`` its place in
    the window: a text that contains the window contains this one at that place,
    so one shingle is all the prefix that exact containment needs.
    """

    keys: list[np.ndarray]
    lengths: list[np.ndarray]
    items: list[list[str]]
    prefix_key: np.ndarray | None = None
    prefix_at: np.ndarray | None = None

    @staticmethod
    def of(items: list[tuple[str, str]], window: int) -> Windows:
        held = words_of_texts([t for _, t in items])
        found: dict[bytes, int] = {}
        keys, lengths, owners = [], [], []
        for i, (item, _) in enumerate(items):
            begin, end = int(held.first[i]), int(held.first[i + 1])
            width = min(window, end - begin)
            for at in range(begin, end - width + 1) if width else ():
                k, n = held.keys[at : at + width], held.lengths[at : at + width]
                place = found.setdefault(k.tobytes() + n.tobytes(), len(keys))
                if place == len(keys):
                    keys.append(k)
                    lengths.append(n)
                    owners.append(set())
                owners[place].add(item)
        return Windows(keys, lengths, [sorted(o) for o in owners])

    def shingles(self) -> np.ndarray:
        """All distinct shingle keys of the windows, sorted."""
        every = [_shingles(k, _shingle_length(len(k))) for k in self.keys]
        return np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)

    def choose_prefixes(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        """Orders each window's shingles by rarity in the reports and keeps the rarest."""
        at, key = [], []
        for k in self.keys:
            own = _shingles(k, _shingle_length(len(k)))
            rare = int(np.argmin(counts[np.searchsorted(shingles, own)]))
            at.append(rare)
            key.append(own[rare])
        order = np.argsort(np.array(key, np.uint64), kind="stable")
        self.prefix_key = np.array(key, np.uint64)[order]
        self.prefix_at = np.array(at, np.int64)[order]
        self.keys = [self.keys[i] for i in order]
        self.lengths = [self.lengths[i] for i in order]
        self.items = [self.items[i] for i in order]


def words_of_texts(texts: list[str | None]) -> Words:
    parts = [words_of(data, offsets) for _, _, data, offsets in chunks(pa.array(texts, pa.string()))]
    if not parts:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    shift, first = 0, [np.zeros(1, np.int64)]
    for p in parts:
        first.append(p.first[1:] + shift)
        shift += len(p.keys)
    return Words(np.concatenate([p.keys for p in parts]), np.concatenate([p.lengths for p in parts]), np.concatenate(first))


def _shingles(keys: np.ndarray, length: int) -> np.ndarray:
    """Keys of all runs of ``length`` words, also over the border of two texts."""
    if length == 1:
        return keys
    return keys[:-1] * np.uint64(0x9FB21C651E98DF25) + keys[1:]


def decontaminate(
    reports: DataFrame,
    held_out: DataFrame,
    key: str = "event_id",
    text: str = "report",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each report lie inside a window of a held-out item.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. Method: prefix-filtered set join. The windows'
    shingles are ordered by their number of occurrences in all reports; each
    window joins on its rarest one. Length and position bounds follow: the
    window must begin and end inside the report when the shingle is laid on its
    place. What is left is verified word by word over the item-sized window
    (64-bit keys and byte lengths of all words).

    Items are taken along in blocks of about ``block_bytes`` of their text (one
    item at least), dealt by hash. The driver brings one block at a time and
    hands its windows to the tasks, so neither's memory grows with the items;
    each block is two passes over the reports, one to count and one to match.
    The reports' texts are never shuffled.

    Returns per input row: ``key``, ``columns``, n_words, n_hit (words inside any occurrence
    of a window), spans (array of start, end in words; merged), items (sorted
    identifiers, as text, of items with an occurring window).

    Edge cases: a null text has no words; items without words or identifier
    occur nowhere; items with equal texts are all named. Equal rows each get
    their result. Empty tables give an empty result or no hits. Other columns
    are ignored unless named in ``columns``.
    """
    spark = reports.sparkSession
    ship_package(spark)
    rest = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns) if c != text]
    texts = reports.select(F.col(key).alias("id"), F.col(text).alias("text"), *rest)
    items = held_out.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    if blocks > 1:
        items = durable(items, "items")
        texts = durable(texts.withColumn("row", F.monotonically_increasing_id()), "reports")
    else:
        texts = texts.withColumn("row", F.lit(0).cast("long"))
    held = [F.col("text" if c == text else f"_{i}").alias(c) for i, c in enumerate(columns)]
    found = []
    for number in range(blocks):
        of = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number
        windows = Windows.of([tuple(r) for r in items.where(of).toLocalIterator()], window)
        # The first pass carries the kept columns along.
        given = texts if number == 0 and columns else texts.select("id", "row", "text")
        more = _matched(given, windows, _counts(texts, windows), number == 0 and text in columns)
        # One block's windows are held at a time.
        found.append(durable(more, "hits") if blocks > 1 else more)
    if len(found) == 1:
        merged = found[0]
    else:
        # Reports without a hit come from the first block only.
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more.where(F.size("starts") > 0), allowMissingColumns=True)
        kept = [c for c in rows.columns if c == "text" or c.startswith("_")]
        merged = rows.groupBy("row").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            *[F.first(c, ignorenulls=True).alias(c) for c in kept],
            F.flatten(F.collect_list("starts")).alias("starts"),
            F.flatten(F.collect_list("ends")).alias("ends"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    spans = _union_of(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    return merged.select(F.col("id").alias(key), *held, "n_words", spans.alias("spans"), "items").select(
        key,
        *columns,
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        "spans",
        "items",
    )


def _union_of(spans):
    """Merges overlapping spans, given in any order."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return (
            F.when(F.size(done) == 0, F.array(span))
            .when(span["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(span)))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def _counts(texts: DataFrame, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """How often each of the windows' shingles occurs in all reports."""
    shingles = windows.shingles()
    if not len(shingles):
        return shingles, np.zeros(0, np.int64)
    spark = texts.sparkSession
    wanted = spark.sparkContext.broadcast(shingles)
    lengths = sorted({_shingle_length(len(k)) for k in windows.keys})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                words = words_of(data, offsets)
                for length in lengths:
                    got = _shingles(words.keys, length)
                    at = np.searchsorted(wanted.value, got)
                    at[at == len(total)] = 0
                    total += np.bincount(at[wanted.value[at] == got], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["shingle", "n"])

    # One number for each shingle of the block, at most.
    summed = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(shingles), np.int64)
    for row in summed.collect():
        counts[row["shingle"]] = row["n"]
    return shingles, counts


def _matched(
    texts: DataFrame, windows: Windows, counted: tuple[np.ndarray, np.ndarray], with_text: bool
) -> DataFrame:
    windows.choose_prefixes(*counted)
    block = texts.sparkSession.sparkContext.broadcast(windows)
    kept = [f for f in texts.schema.fields if f.name.startswith("_") or f.name == "text" and with_text]
    names = [f.name for f in kept]
    schema = T.StructType([texts.schema["id"], *kept]).add("row", "long").add("n_words", "long")
    places = T.ArrayType(T.LongType())
    schema = schema.add("starts", places).add("ends", places).add("items", T.ArrayType(T.StringType()))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            texts_of, ids, row = batch.column("text"), batch.column("id"), batch.column("row")
            for begin, to, data, offsets in chunks(texts_of):
                words = words_of(data, offsets)
                starts, ends, items = _occurrences(words, held)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[begin:to],
                        *[batch.column(name)[begin:to] for name in names],
                        row[begin:to],
                        pa.array(np.diff(words.first)),
                        pa.array(starts, pa.list_(pa.int64())),
                        pa.array(ends, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["id", *names, "row", "n_words", "starts", "ends", "items"],
                )

    return texts.mapInArrow(match, schema)


def _occurrences(words: Words, held: Windows) -> tuple[list, list, list]:
    """Per text: merged starts and ends of hit words, and the items."""
    n = len(words.first) - 1
    starts: list[list[int]] = [[] for _ in range(n)]
    ends: list[list[int]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if not len(words.keys) or not held.keys:
        return starts, ends, items
    widths = np.array([len(k) for k in held.keys])
    place, which = _candidates(words, held, widths)
    begin = place - held.prefix_at[which]
    end = begin + widths[which]
    text = np.searchsorted(words.first, place, side="right") - 1
    bounded = (begin >= words.first[text]) & (end <= words.first[text + 1])
    begin, which, text = begin[bounded], which[bounded], text[bounded]
    same = np.ones(len(begin), bool)
    for width in np.unique(widths[which]):
        of = np.flatnonzero(widths[which] == width)
        for part in range(0, len(of), 4096):
            rows = of[part : part + 4096]
            at = begin[rows][:, None] + np.arange(width)
            keys = np.stack([held.keys[i] for i in which[rows]])
            sizes = np.stack([held.lengths[i] for i in which[rows]])
            same[rows] = (words.keys[at] == keys).all(axis=1) & (words.lengths[at] == sizes).all(axis=1)
    begin, which, text = begin[same], which[same], text[same]
    if not len(begin):
        return starts, ends, items
    # Words inside any occurrence, then runs of them that stay in one text.
    cover = np.zeros(len(words.keys) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + widths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    before = np.zeros(len(hit), bool)
    before[1:] = hit[:-1]
    edges = words.first[1:-1][words.first[1:-1] < len(hit)]
    before[edges] = False
    after = np.zeros(len(hit), bool)
    after[:-1] = hit[1:]
    after[edges[edges > 0] - 1] = False
    opened, closed = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    for t, o, c in zip((np.searchsorted(words.first, opened, side="right") - 1).tolist(), opened.tolist(), closed.tolist(), strict=True):
        starts[t].append(o - int(words.first[t]))
        ends[t].append(c - int(words.first[t]))
    found = np.unique(text * len(widths) + which)
    for t, w in zip((found // len(widths)).tolist(), (found % len(widths)).tolist(), strict=True):
        items[t].extend(held.items[w])
    return starts, ends, [sorted(set(i)) for i in items]


def _candidates(words: Words, held: Windows, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the prefix shingle, window) wherever a window's rarest shingle occurs."""
    places, which = [], []
    lengths = np.minimum(SHINGLE_WORDS, widths)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        key = held.prefix_key[own]
        got = _shingles(words.keys, int(length))
        low, high = np.searchsorted(key, got, side="left"), np.searchsorted(key, got, side="right")
        many = high - low
        at = np.flatnonzero(many)
        place = np.repeat(at, many[at])
        nth = np.arange(len(place)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
        places.append(place)
        which.append(own[np.repeat(low[at], many[at]) + nth])
    return np.concatenate(places), np.concatenate(which)
