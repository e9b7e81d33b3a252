"""Readers and sinks for survey files: FITS images, VOTables, spaced tables, manifests and immutable objects."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.maths import half_up
from starloom.operators.rollups import streamed_sha256
from starloom.sources.storage import written

#: Fixed values of the FITS format.
BLOCK, CARD = 2880, 80
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_header(data: bytes) -> tuple[dict[str, str], int]:
    """Cards of the primary header as text, and where its data begin."""
    cards: dict[str, str] = {}
    for at in range(0, len(data), CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        name = card[:8].strip()
        if name == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            value = card[10:].strip()
            cards[name] = value[1:].split("'")[0].strip() if value.startswith("'") else value.split("/")[0].strip()
    raise ValueError("no END card")


def fits_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and image as float32; a cube becomes the mean of its planes, without NaN."""
    if len(data) < BLOCK or not data.startswith(b"SIMPLE  ="):
        raise ValueError("not a FITS file")
    header, at = fits_header(data)
    shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
    kind = np.dtype(DTYPES[int(header["BITPIX"])])
    image = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape).astype(np.float32)
    image = image * np.float32(header.get("BSCALE", 1)) + np.float32(header.get("BZERO", 0))
    return header, np.nanmean(image, axis=0) if image.ndim == 3 else image


def ones_sum(data: bytes) -> int:
    """The 32-bit ones' complement sum of big-endian words."""
    total = int(np.frombuffer(data, ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def checksum_text(total: int) -> str:
    """Sixteen letters and digits that, at the place of a CHECKSUM card's value, bring a sum of total to all ones.

    Each byte of the complement is dealt over four characters from 0 on; pairs of these that would not be letters or digits
    are moved apart, one up and one down. The text is turned by one, since a card's value begins one byte before a word.
    """
    out = bytearray(16)
    for i, byte in enumerate((0xFFFFFFFF - total).to_bytes(4, "big")):
        four = [byte // 4 + ord("0")] * 4
        four[0] += byte % 4
        for j in (0, 2):
            while not all(chr(c).isalnum() for c in four[j : j + 2]):
                four[j], four[j + 1] = four[j] + 1, four[j + 1] - 1
        for j, c in enumerate(four):
            out[4 * j + i] = c
    return (out[-1:] + out[:-1]).decode("ascii")


def with_checksums(image: np.ndarray, cards: dict[str, str]) -> bytes:
    """The FITS file with DATASUM and CHECKSUM cards: the sum of all its words is all ones."""
    plain = fits_bytes(image, cards)
    data = plain[fits_header(plain)[1] :]
    whole = fits_bytes(image, cards | {"CHECKSUM": "0" * 16, "DATASUM": str(ones_sum(data))})
    return whole.replace(b"CHECKSUM= '" + b"0" * 16, b"CHECKSUM= '" + checksum_text(ones_sum(whole)).encode("ascii"), 1)


def verified(content: bytes) -> bool:
    """Whether a file with checksum cards is as it was written."""
    header, at = fits_header(content)
    return len(content) % 4 == 0 and ones_sum(content) == 0xFFFFFFFF and int(header["DATASUM"]) == ones_sum(content[at:])


def fits_bytes(image: np.ndarray, cards: dict[str, str]) -> bytes:
    """A two-dimensional float32 image as a FITS file; equal input gives equal bytes."""
    rows = [f"{'SIMPLE':8}= {'T':>20}", f"{'BITPIX':8}= {-32:>20}", f"{'NAXIS':8}= {image.ndim:>20}", *(f"{f'NAXIS{i}':8}= {n:>20}" for i, n in enumerate(reversed(image.shape), 1))]
    rows += [f"{k:8}= '{v:8}'" for k, v in sorted(cards.items())] + ["END"]
    head, data = "".join(r.ljust(CARD) for r in rows).encode("ascii"), image.astype(">f4").tobytes()
    return head + b" " * (-len(head) % BLOCK) + data + b"\0" * (-len(data) % BLOCK)


def is_fits(head: Column, size: Column) -> Column:
    """Whether a file begins as a FITS file or extension does, and is a block long at least."""
    return F.coalesce((F.startswith(head, F.lit("SIMPLE  =")) | F.startswith(head, F.lit("XTENSION="))) & (size >= BLOCK), F.lit(False))


def write_objects(objects: DataFrame, folder: str) -> None:
    """Writes objects (name, content) as files of a folder on the shared file system, each by the task that has it.

    A file is written under a name of its own and then renamed, so a task that is tried again leaves the same files.
    """
    system, root = pa.fs.FileSystem.from_uri(folder) if ":" in folder else (pa.fs.LocalFileSystem(), folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, base = pa.fs.FileSystem.from_uri(folder) if ":" in folder else (pa.fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                draft = f"{base}/.{name}-{uuid.uuid4().hex}"
                with there.open_output_stream(draft) as out:
                    out.write(content)
                there.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    objects.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def answered(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """The union of the sources that answer; an error only if none does.

    Spark reads late, so a source has answered when all its rows have been read: they are written, and the union is of what
    was written. A source that fails at any point before gives no row.
    """
    found, errors = [], []
    for source in sources:
        try:
            found.append(written(source(), "source"))
        except Exception as e:  # whatever keeps a source from answering
            errors.append(e)
    if not found:
        raise RuntimeError(f"no source answers: {errors}")
    return reduce(DataFrame.unionByName, found)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, y, values): a row for each image row of each file; files that aren't FITS give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    header, image = fits_image(content.as_py())
                except (ValueError, KeyError):
                    continue
                n = len(image)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([list(header.items())] * n, pa.map_(pa.string(), pa.string())), pa.array(range(n), pa.int32()), pa.array(list(image), pa.list_(pa.float32()))],
                    ["path", "header", "y", "values"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, header map<string,string>, y int, values array<float>")


def fits_pixels(rows: DataFrame) -> DataFrame:
    """(frame, y, x, value): one row a pixel."""
    return rows.select(F.col("path").alias("frame"), "y", F.posexplode("values").alias("x", "value")).withColumn("value", F.col("value").cast("double"))


def read_votable(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of a VOTable's TABLEDATA as text columns in field order; empty cells are null."""
    rows = spark.read.format("xml").option("rowTag", "TR").schema("TD array<string>").load(path)
    return rows.select(*(F.nullif(F.trim(F.get("TD", F.lit(i))), F.lit("")).alias(f) for i, f in enumerate(fields)))


def read_spaced(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header and fields apart by spaces; rows with fields missing are left out."""
    rows = spark.read.csv(path, sep=" ", header=True, ignoreLeadingWhiteSpace=True)
    return rows.dropna("any")


def cache_path(sha: Column) -> Column:
    return F.concat_ws("/", F.left(sha, F.lit(2)), sha)


def immutable_writes(present: DataFrame, arrivals: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, outcome): new objects are written, equal ones replayed, and others are conflicts."""
    old = present.select(key, F.col(checksum).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "written").when(F.col("_old") == F.col(checksum), "replayed").otherwise("conflict")
    return arrivals.join(old, key, "left").select(key, outcome.alias("outcome"))


def within_bytes(files: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Files of each group in order while the bytes before and with each stay within the budget."""
    upto = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return files.withColumn("upto", F.sum(size).over(upto)).where(F.col("upto") <= budget)


def interleaved(lists: list[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """One of each list in turn, each key once, the first limit rows."""
    out = None
    for n, rows in enumerate(lists):
        few = rows.select(key, order).orderBy(order).limit(limit)  # a top-k; only these rows meet in one task
        rows = few.select(key, F.row_number().over(W.orderBy(order)).alias("turn"), F.lit(n).alias("list"))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy(key).agg(F.min(F.struct("turn", "list")).alias("at"))
    return first.select(key, "at.turn", "at.list").orderBy("turn", "list").limit(limit)


def manifest(tiles: DataFrame, group: str) -> DataFrame:
    """For each group the rows and the SHA-256 of its canonical JSON list of (order, index), as manifest_rows() has them."""
    return streamed_sha256(manifest_rows(tiles), [group], "row", ["index"], "[", ",", "]")


def manifest_rows(tiles: DataFrame) -> DataFrame:
    """The tiles, each with its row of the manifest."""
    return tiles.withColumn("row", F.to_json(F.struct("index", "order")))


def privacy_rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), 1) for c in columns})
