"""Atomic publication: generations of tables that readers see as a whole or not at all.

A published place is a folder with generations, each written under a name of its own, and numbered versions: small JSON files
that name a generation and what it holds. Publishing is stage, verify, switch: the generation is written; its files are read
back and held against the rows and the digest that were to be written; then the next version's file is created, in one step
that fails where the file is there already. Two publishers that started from one version can't both succeed, so this is a
compare-and-set of the version. Readers take the highest version; nothing that one may be reading is overwritten or removed
but by prune(), which leaves the last few.

The one step is a hard link on a local file system, and a rename that doesn't replace elsewhere; a file system must offer
either (HDFS does; a plain object store does not).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Superseded(RuntimeError):
    """Another publisher was first."""


class Unverified(RuntimeError):
    """What was staged is not what was to be written."""


@dataclass(frozen=True)
class Version:
    """What a version's file says. number 0: nothing published yet."""

    number: int
    folder: str = ""
    rows: int = 0
    digest: int = 0


def content(df: DataFrame) -> tuple[int, int]:
    """Number of rows, and a sum of hashes of them that doesn't hang on their order."""
    low = F.xxhash64(*df.columns).bitwiseAND(F.lit((1 << 31) - 1))  # sums of 2 ** 32 rows fit
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(low), F.lit(0)).alias("h")).first()
    return r.n, r.h


class Published:
    """A place where generations of one table are published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path("versions")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """The version of a number, or the current one."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version(0)
        stream = self._fs.open(self._path(f"versions/{number:010d}.json"))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def stage(self, df: DataFrame) -> Version:
        """Writes a generation that no version names yet, and reads it back. number is that of the version it builds on."""
        before, folder = self.version().number, f"generation-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        rows, digest = content(self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}"))
        return Version(before, folder, rows, digest)

    def verify(self, staged: Version, schema: T.StructType, rows: int | None = None, digest: int | None = None) -> None:
        """Raises Unverified unless the staged files hold what they are to hold: what stage() read, and rows and digest where given."""
        if not self._fs.exists(self._path(staged.folder)):
            raise Unverified(f"{staged.folder} is gone")
        found = content(self.spark.read.schema(schema).parquet(f"{self.root}/{staged.folder}"))
        if found != (staged.rows, staged.digest) or rows not in (None, found[0]) or digest not in (None, found[1]):
            raise Unverified(f"{staged.folder} holds {found}")

    def switch(self, staged: Version) -> Version:
        """Makes a staged generation the current one, if the version it was built on still is; else raises Superseded."""
        if self.version().number != staged.number:
            raise Superseded(f"version {staged.number} is not the current one")
        new = Version(staged.number + 1, staged.folder, staged.rows, staged.digest)
        draft, final = f"versions/.draft-{uuid.uuid4().hex}", f"versions/{new.number:010d}.json"
        out = self._fs.create(self._path(draft), False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        try:
            self._name(draft, final)
        finally:
            self._fs.delete(self._path(draft), False)
        return new

    def _name(self, draft: str, final: str) -> None:
        """Gives a finished file its name, unless the name is taken."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(urlparse(f"{self.root}/{draft}").path, urlparse(f"{self.root}/{final}").path)
            except FileExistsError:
                raise Superseded(final) from None
            return
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(final), plain)
        except Exception as e:
            if self._fs.exists(self._path(final)):
                raise Superseded(final) from e
            raise

    def publish(self, df: DataFrame) -> Version:
        """Stages, verifies against df's own rows, and switches."""
        staged = self.stage(df)
        self.verify(staged, df.schema, *content(df))
        return self.switch(staged)

    def read(self, schema: T.StructType, number: int | None = None) -> DataFrame:
        """The rows of the current version, or of one that is kept; none before anything is published."""
        v = self.version(number)
        if not v.number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{v.folder}")

    def prune(self, keep: int = 2) -> None:
        """Removes generations and versions but the last few. What is staged and not published stays."""
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(self.version(number).folder), True)
            self._fs.delete(self._path(f"versions/{number:010d}.json"), False)
