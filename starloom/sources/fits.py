"""FITS images as a data source: ``spark.read.format("fits").option("cards", "OBJECT,FILTER").load(folder)``.

A file is cut into byte ranges, which are dealt to tasks, so a large image is read by several tasks and never held whole.
Planning only lists the files; each task reads the header, finds the image rows that begin in its range, and reads these.
Header cards that are asked for are columns. Equality and membership filters on them are pushed into the source: a file whose
header doesn't fit is not read beyond it.

Columns: path, size (of the file), width, height, one for each card (text, null where it is missing), y and values (a row as
float32; of a cube the mean of its planes, without NaN). Files that don't begin as FITS give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from starloom.sources.readers import BLOCK, DTYPES, fits_header

RANGE_BYTES = 32 << 20
#: Ranges become tasks of their own up to this many; with more, neighbours are read by one task, one after the other.
TASKS = 1024
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_FIXED = ("path", "size", "width", "height")


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path else (pa.fs.LocalFileSystem(), path)


class Range(InputPartition):
    """Byte ranges (path, size of the file, start, stop) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class FitsReader(DataSourceReader):
    def __init__(self, folder: str, cards: list[str], range_bytes: int):
        self.folder, self.cards, self.range_bytes = folder, cards, range_bytes
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what asks for values of cards; gives the rest back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.cards:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = _opened(self.folder)
        files = [f for f in system.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        ranges = [(f.path, f.size, at, min(at + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), self.range_bytes)]
        each = max(1, -(-len(ranges) // TASKS))
        return [Range(ranges[i : i + each]) for i in range(0, len(ranges), each)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        for path, size, start, stop in partition.ranges:
            yield from self._rows(system, path, size, start, stop)

    def _rows(self, system: pa.fs.FileSystem, path: str, size: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(path) as file:
            head = file.read(BLOCK)
            if len(head) < BLOCK or not head.startswith(b"SIMPLE  ="):
                return
            while True:  # a header is as many blocks as it takes
                try:
                    header, data = fits_header(head)
                    break
                except ValueError:
                    more = file.read(BLOCK)
                    if not more:
                        return
                    head += more
            shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
            if len(shape) not in (2, 3) or any(header.get(card) not in values for card, values in self.wanted):
                return
            kind = np.dtype(DTYPES[int(header["BITPIX"])])
            planes, (height, width) = (shape[0] if len(shape) == 3 else 1), shape[-2:]
            row = width * kind.itemsize
            first, last = (max(0, min(height, -((data - at) // row))) for at in (start, stop))  # rows of the first plane that begin in the range
            if stop == size:
                last = height
            step = max(1, (4 << 20) // max(1, row * planes))
            scale, zero = np.float32(header.get("BSCALE", 1)), np.float32(header.get("BZERO", 0))
            for y in range(first, last, step):
                n = min(step, last - y)
                parts = []
                for p in range(planes):
                    body = file.read_at(n * row, data + (p * height + y) * row)
                    parts.append(np.frombuffer(body, kind, n * width).reshape(n, width).astype(np.float32) * scale + zero)
                image = np.nanmean(parts, axis=0) if planes > 1 else parts[0]
                fixed = [pa.array([v] * n) for v in (path, size, width, height)]
                cards = [pa.array([header.get(c)] * n, pa.string()) for c in self.cards]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(image.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*fixed, *cards, pa.array(range(y, y + n), pa.int32()), values], [*_FIXED, *self.cards, "y", "values"])


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def _cards(self) -> list[str]:
        return [c for c in self.options.get("cards", "").split(",") if c]

    def schema(self) -> str:
        cards = "".join(f"`{c}` string, " for c in self._cards())
        return f"path string, size bigint, width bigint, height bigint, {cards}y int, values array<float>"

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options["path"], self._cards(), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FitsSource)


def checksums(spark: SparkSession, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, size, sha256) of every file, each read in chunks by one task."""
    system, root = _opened(folder)
    files = [(f.path, f.size) for f in system.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = _opened(folder)
        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                sha = hashlib.sha256()
                with there.open_input_stream(path) as stream:
                    while part := stream.read(chunk):
                        sha.update(part)
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "size", "sha256"])

    return spark.createDataFrame(files, "path string, size bigint").repartition(max(1, min(len(files), 10_000))).mapInArrow(run, "path string, size bigint, sha256 string")
