"""Packing token pieces of incident reports into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.tokens import encoder, text_batches
from kerbline.llm.workers import ship_package
from kerbline.session import durable

SEQUENCE = 2048
# Pieces that one group packs by itself.
GROUP_PIECES = 4096


class CapacityTree:
    """A tournament tree over bins: each node knows the largest free space below it."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, (bins - 1).bit_length())
        self._free = [capacity] * (2 * self._leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room; its number and the space it had free."""
        free, node = self._free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self._leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        up = node // 2
        while up:
            most = max(free[2 * up], free[2 * up + 1])
            if free[up] == most:
                break
            free[up] = most
            up //= 2
        return node - self._leaves, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size: the largest first, each into the first bin with room."""
    tree = CapacityTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.take(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def token_pieces(
    reports: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    key: str = "event_id",
    text: str = "report",
    sequence: int = SEQUENCE,
    release: bool = False,
) -> DataFrame:
    """The reports' identifiers, each with ``end_id`` at its end, in pieces of at most ``sequence``.

    Returns ``key``, start, length, ids_crc32, doc_tokens. Texts do not leave
    the task that reads them, and identifiers are only summed up here. With
    ``release`` a task hands the encoder's memory back at its end, for workers
    that go on to other operators; otherwise their next tasks use it.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, to in text_batches(texts):
                of, starts, lengths, sums, totals = [], [], [], [], []
                for place, found in enumerate(held.encode(texts[begin:to]), begin):
                    ids, total = found + end, len(found) // 4 + 1
                    for start in range(0, total, sequence):
                        part = ids[4 * start : 4 * (start + sequence)]
                        of.append(place)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        totals.append(total)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(of, pa.int64())), *[pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]],
                    ["key", "start", "length", "ids_crc32", "doc_tokens"],
                )
        if release:
            held.forget()

    rows = reports.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return found.withColumnRenamed("key", key)


def pack_reports(
    reports: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    key: str = "event_id",
    text: str = "report",
    sequence: int = SEQUENCE,
    group_pieces: int = GROUP_PIECES,
    seed: int = 0,
    release: bool = False,
) -> DataFrame:
    """Assigns every piece of every report to a sequence of at most ``sequence`` identifiers.

    Method: first-fit decreasing with a tournament tree of the bins' free space,
    run independently in groups of about ``group_pieces`` pieces drawn at random
    (the draw is stored with the piece, so a repeated task sees the same groups,
    and no key decides a group's size). Whole pieces fill a sequence alone.

    Returns ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Edge cases: a null text is empty and gives ``end_id`` alone; null and
    repeated keys are packed like others; ties in size fall by the draw. An
    empty table gives an empty result. Other columns are ignored.
    """
    ship_package(reports.sparkSession)
    names = ("start", "length", "ids_crc32", "doc_tokens")
    pieces = token_pieces(reports, tokenizer_path, end_id, key, text, sequence, release)
    pieces = durable(
        pieces.select(F.col(key).alias("key"), *names, F.rand(seed).alias("draw")), "token-pieces"
    )
    groups = max(1, ceil(pieces.count() / group_pieces))
    kind = pieces.schema["key"].dataType.simpleString()

    def pack(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("draw").drop_columns(["draw", "pack_group"])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), sequence)
        # A group has far fewer than 2^32 bins.
        rows = rows.append_column("sequence_id", pa.array((group[0].as_py() << 32) + bins))
        return rows.append_column("offset", pa.array(offsets))

    packed = (
        pieces.withColumn("pack_group", F.floor(F.col("draw") * groups).cast("long"))
        .groupBy("pack_group")
        .applyInArrow(
            pack,
            f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
    return packed.withColumnRenamed("key", key)
