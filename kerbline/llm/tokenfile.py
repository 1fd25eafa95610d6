"""Token files: independent zstandard frames with a document index and a seek table."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.tokens import encoder, text_batches
from kerbline.llm.workers import ship_package
from kerbline.session import durable, new_path

# Fixed values of the public seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

# A frame closes once it holds so many identifiers; a document is never split.
FRAME_IDS = 1 << 16
# Characters by which the texts of one key are dealt to files.
RANGE_CHARS = 16
# Text bytes of the documents that one file should hold.
FILE_BYTES = 32 << 20

MANIFEST = "path string, part int, first_key long, documents long, ids long"


def _store(uri: str):
    """The file system that ``uri`` names, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenFileWriter:
    """Writes documents one after another; memory holds one open frame and the index.

    Layout: data frames (zstandard, each with a content checksum), one skippable
    frame with the document index (key, number of identifiers; null keys as the
    smallest long), one skippable frame with the seek table: per data frame its
    compressed size, its size and the low 32 bits of the xxh64 of its content.
    """

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        self._sink, self._frame_ids = sink, frame_ids
        self._zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._open: list[bytes] = []
        self._held = 0
        self._frames: list[tuple[int, int, int]] = []
        self._keys: list[int] = []
        self._counts: list[int] = []

    def add(self, key: int, ids: bytes) -> None:
        self._keys.append(key)
        self._counts.append(len(ids) // 4)
        self._open.append(ids)
        self._held += len(ids) // 4
        if self._held >= self._frame_ids:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self._held:
            return
        content = b"".join(self._open)
        frame = self._zstd.compress(content)
        self._frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._sink.write(frame)
        self._open, self._held = [], 0

    def finish(self) -> None:
        self._close_frame()
        index = zstandard.compress(
            np.array(self._keys, "<i8").tobytes() + np.array(self._counts, "<u4").tobytes()
        )
        self._sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self._frames)
        table += struct.pack("<IBI", len(self._frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


NO_KEY = -(1 << 63)


class TokenFileReader:
    """Reads the tail of a token file, then only the frames that are asked for."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a token file with checksums")
        table = self._at(size - 9 - 12 * count, 12 * count)
        entries = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checksums = entries[:, 1], entries[:, 2]
        self._packed = entries[:, 0]
        self._offsets = np.concatenate([[0], np.cumsum(self._packed)])
        where = int(self._offsets[-1])
        kind, length = struct.unpack("<II", self._at(where, 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("the document index is missing")
        index = zstandard.decompress(self._at(where + 8, length))
        documents = len(index) // 12
        self.keys = np.frombuffer(index, "<i8", documents)
        self.counts = np.frombuffer(index, "<u4", documents, 8 * documents).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self._frame_starts = np.concatenate([[0], np.cumsum(self.sizes // 4)])

    def _at(self, offset: int, length: int) -> bytes:
        self._source.seek(offset)
        return self._source.read(length)

    def frame(self, number: int) -> bytes:
        packed = self._at(int(self._offsets[number]), int(self._packed[number]))
        content = zstandard.decompress(packed)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksums[number]:
            raise ValueError(f"frame {number} is damaged")
        return content

    def document(self, place: int) -> bytes:
        """The identifiers of the document at ``place``; decompresses its frame only."""
        if not self.counts[place]:
            return b""
        number = int(np.searchsorted(self._frame_starts, self.starts[place], side="right")) - 1
        begin = 4 * int(self.starts[place] - self._frame_starts[number])
        return self.frame(number)[begin : begin + 4 * int(self.counts[place])]

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(key, start in the file, identifiers) in the file's order, one frame in memory."""
        place = 0
        for number in range(len(self.sizes)):
            content, base = self.frame(number), int(self._frame_starts[number])
            while place < len(self.keys) and self.starts[place] < self._frame_starts[number + 1]:
                begin = 4 * (int(self.starts[place]) - base)
                yield int(self.keys[place]), base + begin // 4, content[begin : begin + 4 * int(self.counts[place])]
                place += 1
        for rest in range(place, len(self.keys)):  # empty documents at the end belong to no frame
            yield int(self.keys[rest]), int(self.starts[rest]), b""


def write_token_files(
    reports: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    key: str = "event_id",
    text: str = "report",
    file_bytes: int = FILE_BYTES,
    root: str | None = None,
) -> DataFrame:
    """Encodes reports and writes their identifiers to token files in ascending key order.

    Method: rows are range-partitioned by key and sorted; each task encodes its
    rows as a stream, appends ``end_id`` to each and writes one file under
    ``root`` (default: a new folder in the shared folder). Every attempt of a
    task writes a new name, and only names in the returned manifest count, so a
    lost executor or a repeated task leaves no half file in the result.

    Returns the manifest, one row per file in key order: path, part, first_key,
    documents, ids, start (identifiers in all files before it).

    Edge cases: a null text is empty and gives ``end_id`` alone; a null key sorts
    first and is read back as null. Equal keys follow each other by text. An
    empty table gives an empty manifest. Other columns are ignored.
    """
    spark = reports.sparkSession
    ship_package(spark)
    root = root or new_path(spark, "tokens")
    rows = reports.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    files = max(1, ceil(size / file_bytes))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, sink, part = encoder(tokenizer_path).encode, None, None, None
        documents = ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            if writer is None:
                store, folder = _store(root)
                store.create_dir(folder, recursive=True)
                part, first = batch.column("part")[0].as_py(), keys[0]
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.tok"
                sink = store.open_output_stream(f"{folder}/{name}")
                writer = TokenFileWriter(sink)
            for begin, to in text_batches(texts):
                for k, found in zip(keys[begin:to], encode(texts[begin:to]), strict=True):
                    writer.add(NO_KEY if k is None else k, found + end)
                    documents, ids = documents + 1, ids + len(found) // 4 + 1
        if writer is not None:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [f"{root}/{name}"],
                    "part": pa.array([part], pa.int32()),
                    "first_key": pa.array([first], pa.int64()),
                    "documents": [documents],
                    "ids": [ids],
                }
            )

    # Rows of one key, say those without any, are told apart by how their texts begin.
    ordered = rows.repartitionByRange(
        files, F.col("key").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS)
    ).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    written = durable(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(write, MANIFEST), "token-manifest")
    # One row per file, not per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, key: str = "event_id", tasks: int | None = None) -> DataFrame:
    """Every document of the files: ``key``, start (identifiers before it in all files), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                with store.open_input_file(path) as source:
                    reader, out = TokenFileReader(source), []
                    for k, start, ids in reader.documents():
                        out.append((None if k == NO_KEY else k, row["start"] + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    spread = manifest.repartition(tasks or _tasks(manifest.sparkSession), F.xxhash64("path"))
    return spread.mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    keys, starts, counts, sums = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in (keys, starts, counts, sums)], ["key", "start", "n_tokens", "ids_crc32"]
    )
