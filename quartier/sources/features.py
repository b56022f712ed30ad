"""Feature collections (GeoJSON) as a Spark data source: read in parts, written by tasks and committed as a whole.

    register(spark)
    df.write.format("features").mode("overwrite").save(folder)
    spark.read.format("features").load(folder).where("kind = 'Point'")

Rows are (properties map<string,string>, kind string, coordinates string): the properties of a feature, and its geometry's type and coordinates, as JSON text. A file
that has one feature a line, as this writer makes them, is read in parts of ``part_bytes``; any other collection by one task, feature after feature. Comparisons of
``kind`` with a value are pushed to the reader. Files are opened through pyarrow, so their store must be one it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "properties map<string,string>, kind string, coordinates string"
HEAD, TAIL = b'{"type":"FeatureCollection","features":[\n', b"\n]}\n"
PART_BYTES = 32 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _row(feature: dict) -> tuple:
    properties = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in (feature.get("properties") or {}).items()}
    geometry = feature.get("geometry") or {}
    coordinates = geometry.get("coordinates")
    return properties, geometry.get("type"), None if coordinates is None else json.dumps(coordinates)


def _lines(source, start: int, end: int) -> Iterator[dict]:
    """The features on the lines that begin in [start, end)."""
    source.seek(max(0, start - 1))
    held, at = source.read(1 << 16) if start else b"\n" + source.read(1 << 16), start
    first = True
    while True:
        cut = held.find(b"\n")
        while cut < 0:
            more = source.read(1 << 20)
            if not more:
                break
            held += more
            cut = held.find(b"\n")
        line, rest = (held[:cut], held[cut + 1 :]) if cut >= 0 else (held, b"")
        if first:  # what ends at the first line break belongs to the part before
            at, first = max(0, start - 1) + cut + 1 if start else 0, False
        else:
            text = line.strip().rstrip(b",")
            if text.startswith(b'{"type":"Feature"') and not text.startswith(HEAD.strip()):
                yield json.loads(text)
            at += len(line) + 1
        if cut < 0 or at >= end:
            return
        held = rest


def _features(text: str) -> Iterator[dict]:
    """The features of a collection, one after the other; none of anything else."""
    decoder, key = json.JSONDecoder(), text.find('"features"')
    at = text.find("[", key) + 1 if key >= 0 else 0
    while at:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] != "{":
            return
        feature, at = decoder.raw_decode(text, at)
        yield feature


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int
    by_line: bool


class Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes, self.kinds = path, part_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} if self.kinds is None else self.kinds & {f.value}
            else:
                yield f

    def partitions(self) -> Sequence[Part]:
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as source:
                by_line = source.read(len(HEAD)) == HEAD
            step = self.part_bytes if by_line else max(1, f.size)
            parts += [Part(f.path, at, min(at + step, f.size), by_line) for at in range(0, f.size, step)]
        return parts or [Part("", 0, 0, False)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as source:
            features = _lines(source, part.start, part.end) if part.by_line else _features(source.read().decode())
            for feature in features:
                row = _row(feature)
                if self.kinds is None or row[1] in self.kinds:
                    yield row


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Writer(DataSourceWriter):
    """Tasks write files whose names begin with a point; the commit gives them their names, and replaces earlier files if asked to."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        name, n = uuid.uuid4().hex, 0
        with store.open_output_stream(f"{path}/.{name}") as out:
            out.write(HEAD)
            for row in rows:
                geometry = None if row.kind is None else {"type": row.kind, "coordinates": json.loads(row.coordinates) if row.coordinates else []}
                feature = {"type": "Feature", "properties": row.properties or {}, "geometry": geometry}
                out.write((b",\n" if n else b"") + json.dumps(feature, separators=(",", ":"), ensure_ascii=False).encode())
                n += 1
            out.write(TAIL)
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(".")] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(f"{path}/.{m.file}", f"{path}/part-{m.file}.geojson") if m.rows else store.delete_file(f"{path}/.{m.file}")
        for f in old:
            store.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/.{m.file}")


class FeatureCollections(DataSource):
    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to sources like it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureCollections)
