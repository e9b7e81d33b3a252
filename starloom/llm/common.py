"""What the corpus operators share: shared storage, word splitting and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.storage import delete_path, shared_dir

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    return Scratch(df.sparkSession, name).write(df, name)


class Scratch:
    """Tables that an operator writes on its way, in a folder of their own under the shared one.

    drop() removes tables that are read no more, so that a long job holds only what it still needs. What the result itself
    reads stays; the folder named by spark.checkpoint.dir is cleared by whoever set it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        self._delete([path for table, path in self.paths if any(table is t for t in tables)])

    def keep_only(self, *tables: DataFrame) -> None:
        self._delete([path for table, path in self.paths if not any(table is t for t in tables)])

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            delete_path(self.spark, path)
        self.paths = [(t, p) for t, p in self.paths if p not in paths]


def shielded(docs: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of these names renamed, so that an operator may add its own, and the names to give back."""
    back = {f"__own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: hidden for hidden, c in back.items()}), back


def shielding(*names: str) -> Callable:
    """For an operator from documents to documents: columns of the input that are named like one that it uses inside come back unharmed."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def shielded_operator(docs: DataFrame, *args, **kwargs) -> DataFrame:
            inside, back = shielded(docs, set(names))
            return operator(inside, *args, **kwargs).withColumnsRenamed(back)

        return shielded_operator

    return wrap


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of runs of characters other than ASCII white space, as long; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about most_bytes of text (one row at least), each with its texts as UTF-8; null is empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, most_bytes + 1]):
        if i > start and size + n > most_bytes:
            part = batch.slice(start, i - start)
            yield part, [x or b"" for x in part.column(column).cast(pa.large_binary()).to_pylist()]
            start, size = i, 0
        size += n


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches in runs of equal keys, each as a table; null equals null. One run is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        if len(rows) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS = {}

#: True for bytes between words: ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(1 << 20, n + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            with np.errstate(over="ignore"):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs buf[starts:stops]."""
    up, down = _powers(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def hashed_words(texts: list[bytes], between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one after the other; the first word of each text and the end; start and end byte of each word in the texts joined by one separator."""
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = np.concatenate([[True], between[buf]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, stops = edges[0::2], edges[1::2]
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    return span_hashes(buf, starts, stops), first, starts, stops


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * U(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of one whole run of words."""
    return grams(words, len(words))[0]
