"""Landed files as a Spark data source: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

Options: ``path`` (a folder that driver and executors share; any address that Arrow's file systems know), ``kind`` (``feed``:
RSS or Atom; ``blocks``: ``key: value`` lines between ``---`` lines; ``json``: one object a line), ``target`` (bytes of the files that
one task reads, 64 MB) and, for streams, ``settle`` (seconds that a file must be old before it is read, 5).

Rows are (file, place, fields, error). Files are read piece by piece, never whole. What cannot be parsed is a row with an
``error`` and no fields: of a broken feed the items before the break are kept, of JSON lines all good lines. A stream's
offset is the time and name of the last file; a file that appears later under an earlier time is not seen, so files are
to be written or moved into the folder within ``settle`` seconds of their time.
"""

from __future__ import annotations

import io
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feed import item_fields, local_name

SCHEMA = "file string, place long, fields map<string,string>, error string"
ARROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
#: Bytes of text after which rows are handed on.
BATCH_BYTES = 4 << 20

Parsed = tuple[int, dict[str, str] | None, str | None]


def _feed(stream) -> Iterator[Parsed]:
    place, above = 0, []
    try:
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if local_name(node.tag) in ("item", "entry"):
                yield place, item_fields(node), None
                place += 1
                if above:
                    above[-1].remove(node)  # a long feed is not kept
    except (ElementTree.ParseError, ValueError, LookupError) as broken:
        yield place, None, str(broken)


def _blocks(stream) -> Iterator[Parsed]:
    place, fields, key = 0, {}, None

    def tidy() -> dict[str, str]:
        return {k: re.sub("[ \t\n\x0b\f\r]+", " ", "\n".join(v)).strip(" ") for k, v in fields.items()}

    try:
        for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
            line = line.rstrip("\n")
            if line.rstrip() == "---":
                if fields:
                    yield place, tidy(), None
                    place += 1
                fields, key = {}, None
                continue
            start = re.match(r"([a-z_]+):", line)
            if start:
                key = start[1] if start[1] not in fields else None  # of equal keys the first stays
                line = line[start.end() :]
            if key:
                fields.setdefault(key, []).append(line)
        if fields:
            yield place, tidy(), None
    except UnicodeDecodeError as broken:
        yield place, None, str(broken)


def _json(stream) -> Iterator[Parsed]:
    for place, raw in enumerate(io.BufferedReader(stream)):
        if not raw.strip():
            continue
        try:
            line = raw.decode().strip()
            known = isinstance(json.loads(line), dict)
        except (ValueError, RecursionError) as broken:
            yield place, None, f"{type(broken).__name__}: {str(broken)[:200]}"
            continue
        yield (place, {"json": line}, None) if known else (place, None, "not an object")


KINDS = {"feed": _feed, "blocks": _blocks, "json": _json}


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names: tuple[str, ...]) -> None:
        self.names = names


class _Landed:
    """What both readers share: listing, packing and reading of files."""

    def __init__(self, options: dict) -> None:
        self.path, self.kind = options.get("path"), options.get("kind", "json")
        if not self.path or self.kind not in KINDS:
            raise ValueError(f"give a path and one of the kinds {sorted(KINDS)}")
        self.target, self.settle = int(options.get("target", 64 << 20)), float(options.get("settle", 5))

    def files(self) -> list[tuple[int, str, int]]:
        """(time, name, bytes) of the files, in order; names that begin with ``_`` or ``.`` are left out."""
        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        shown = (f for f in found if f.is_file and not any(p[:1] in "_." for p in f.path[len(base) :].strip("/").split("/")))
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in shown)

    def packed(self, files: list[tuple[int, str, int]]) -> list[Files]:
        """Files side by side up to ``target`` bytes a task; a larger file is a task of its own."""
        parts, held, size = [], [], 0
        for _, name, length in files:
            if held and size + length > self.target:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(name)
            size += length
        return parts + ([Files(tuple(held))] if held else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_stream(name) as stream:
                for place, fields, error in KINDS[self.kind](stream):
                    rows.append((name, place, None if fields is None else list(fields.items()), error))
                    size += 64 + sum(len(k) + len(v) for k, v in (fields or {}).items())
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class LandedReader(_Landed, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.packed(self.files()) or [Files(())]


class LandedStream(_Landed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": -1, "name": ""}

    def latestOffset(self) -> dict:
        old = time.time_ns() - int(self.settle * 1e9)
        ready = [f for f in self.files() if f[0] <= old]
        return {"at": ready[-1][0], "name": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["name"]), (end["at"], end["name"])
        return self.packed([f for f in self.files() if low < f[:2] <= high])


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def read_landed(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(LandedSource)
    return spark.read.format("landed").options(path=path, kind=kind, **options).load()


def stream_landed(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(LandedSource)
    return spark.readStream.format("landed").options(path=path, kind=kind, **options).load()


def good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def errors(rows: DataFrame) -> DataFrame:
    """(file, place, error): what could not be parsed."""
    return rows.filter(F.col("error").isNotNull()).drop("fields")
