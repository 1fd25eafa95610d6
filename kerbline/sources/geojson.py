"""Batch sink that writes complete GeoJSON documents and publishes them when all of them are there."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from kerbline.sources.sinks import GEOMETRY_COLS, geojson_features

FORMAT = "geojson_collection"
# The workers that plan and run the sink need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _store(uri: str):
    """File system and path of a folder that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class _Part(WriterCommitMessage):
    path: str | None
    features: int


class _Writer(DataSourceArrowWriter):
    """Each task writes one document beside the published ones; the commit moves them into place."""

    def __init__(self, path: str, head: str, overwrite: bool):
        self.path, self.head, self.overwrite = path.rstrip("/"), head, overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, folder = _store(self.staging)
        sink, name, n = None, f"part-{uuid.uuid4().hex}.geojson", 0
        for batch in iterator:
            for feature in batch.column(0).to_pylist():
                if sink is None:
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(f"{folder}/{name}")
                    sink.write(self.head.encode())
                sink.write((",\n" if n else "").encode() + feature.encode())
                n += 1
        if sink is None:
            return _Part(None, 0)
        sink.write(b"]}\n")
        sink.close()
        return _Part(name, n)

    def commit(self, messages: list[_Part | None]) -> None:
        store, folder = _store(self.path)
        _, staged = _store(self.staging)
        parts = [m for m in messages if m and m.path]
        old = [f.path for f in store.get_file_info(self._selector(folder)) if f.base_name.startswith("part-")]
        for nth, part in enumerate(parts):
            store.move(f"{staged}/{part.path}", f"{folder}/{part.path.replace('part-', f'part-{nth:05d}-')}")
        if not parts:  # an empty export is a document too
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/part-00000-{uuid.uuid4().hex}.geojson") as sink:
                sink.write((self.head + "]}\n").encode())
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        self._clear()

    def abort(self, messages: list[_Part | None]) -> None:
        self._clear()

    def _selector(self, folder: str):
        from pyarrow import fs

        return fs.FileSelector(folder, allow_not_found=True)

    def _clear(self) -> None:
        from pyarrow import fs

        store, folder = _store(self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class GeoJsonCollection(DataSource):
    """``df.write.format("geojson_collection")``: one text column of JSON objects, several per document.

    Option ``head`` is what a document begins with, up to its open list.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if len(schema.fields) != 1:
            raise ValueError("one column of JSON objects is written")
        return _Writer(self.options["path"], self.options["head"], overwrite)


def write_collection(scores: DataFrame, path: str) -> None:
    """Exports segments as GeoJSON FeatureCollections, one document per task.

    Without endpoint columns the documents are record lists. Documents appear under
    ``path`` only once all are written; a task that fails or is repeated leaves none,
    and an earlier export goes when the new one is in place.
    """
    located = set(GEOMETRY_COLS) <= set(scores.columns)
    kind, items = ("FeatureCollection", "features") if located else ("RecordList", "records")
    scores.sparkSession.dataSource.register(GeoJsonCollection)
    features = geojson_features(scores)
    features.write.format(FORMAT).mode("overwrite").option("path", path).option(
        "head", f'{{"type": "{kind}", "{items}": ['
    ).save()


def read_collection(spark: SparkSession, path: str, feature_schema: str) -> DataFrame:
    """``feature`` of every document under ``path``."""
    schema = f"type string, features array<{feature_schema}>"
    documents = spark.read.schema(schema).option("pathGlobFilter", "part-*.geojson").json(path, multiLine=True)
    return documents.where("type = 'FeatureCollection'").selectExpr("explode(features) as feature")
