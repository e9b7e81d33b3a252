"""Size-tiered sharding: immutable shards, tiered merges, and a versioned manifest that is committed atomically.

A store is a folder of runs (folders of Parquet shards) and of manifests ``manifest-00000001.json``, ... The manifest of the
highest version lists the live runs by name, with the rows, bytes and files of each; the files themselves are found by
Spark when it reads a run, so a manifest grows with the arrivals and never with the files. Arrivals are appended as small
runs. When a tier (runs whose bytes agree within a factor TIER_RATIO) holds FAN_IN runs, they are rewritten as one run of
files of about the target size; runs whose files have reached half the target are left alone from then on. A merge reads
whole files and writes them together, without a shuffle.

Several writers may work on one store. A run is written under a name of its own and counts only once a manifest lists it.
A version is committed by giving a finished manifest a name that must be new, in one step that fails if it is not (a hard
link on a local file system; elsewhere a rename that doesn't replace, which is one step on HDFS and its like, but not on
plain object stores: these need a store with conditional puts in front), so of two writers one wins; the other takes up the
new version and tries again. An append always succeeds in the end; a merge is given up if another writer has replaced one
of its runs. A commit fails rather than list a run whose files are gone.

vacuum() removes runs that a manifest replaced at least ``retention_s`` ago (and manifests once ``grace_s`` is over too), and runs that no manifest ever listed once
they are older than ``grace_s``: what a lost writer left. A run that is being written or waits for its commit is younger,
and stays.

Any rows are stored as they are: nulls, empty or very long texts, repeated rows and extra columns. Runs of an empty table
hold no rows. The result column names (shard, version, tier) replace input columns of the same name when they are read
back. An arrival without rows adds no run.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, FAN_IN, TIER_RATIO = 128 << 20, 4, 4.0
GRACE_S, RETENTION_S = 86_400.0, 86_400.0
TRIES, MOST_BROADCAST_RUNS = 50, 100_000


def _free(name: str, columns: list[str]) -> str:
    """name, or the first longer one that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class LostRun(RuntimeError):
    """A run that was to be listed has no files any more."""


@dataclass(frozen=True)
class Run:
    """An immutable folder of shards."""

    name: str
    rows: int
    bytes: int
    files: int

    @property
    def tier(self) -> int:
        return tier_of(self.bytes)


def tier_of(size: int, smallest: int = 64 << 10, ratio: float = TIER_RATIO) -> int:
    return max(0, math.floor(math.log(max(size, 1) / smallest, ratio)))


def full_tier(runs: list[Run], target_bytes: int, fan_in: int) -> list[Run]:
    """The runs of the lowest tier that holds fan_in of them; runs of files of half the target or more are left alone."""
    tiers: dict[int, list[Run]] = {}
    for run in runs:
        if run.bytes < run.files * target_bytes // 2:
            tiers.setdefault(run.tier, []).append(run)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan_in), [])


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _status(self, folder: str) -> list:
        return list(self._fs.listStatus(self._path(folder)))

    # manifests

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._status(f"{self.root}/manifests"))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/manifest-{version:08d}.json"

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """Version (the latest unless given) and its runs; version 0 has none."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, []
        stream = self._fs.open(self._path(self._manifest_path(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Publishes runs as this version, or raises CommitConflict."""
        draft = f"{self.root}/manifests/draft-{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(draft), False)
        try:
            out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        finally:
            out.close()
        try:
            self._publish(draft, self._manifest_path(version))
        finally:
            self._fs.delete(self._path(draft), False)
        return version

    def _publish(self, draft: str, final: str) -> None:
        """Gives the draft its final name in one step that fails if the name is taken."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(urlparse(draft).path, urlparse(final).path)
            except FileExistsError:
                raise CommitConflict(final) from None
            return
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(final), never)
        except Exception as e:
            if self._fs.exists(self._path(final)):
                raise CommitConflict(final) from e
            raise

    def _publish_change(self, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commits change(runs) on the latest version, taking up newer versions as long as there is a conflict; None if change gives None."""
        for attempt in range(TRIES):
            version, runs = self.manifest()
            new = change(runs)
            if new is None:
                return None
            for run in set(new) - set(runs):
                if not self._fs.exists(self._path(f"{self.root}/{run.name}")):
                    raise LostRun(run.name)
            try:
                return self.commit(version + 1, new)
            except CommitConflict:
                time.sleep(min(1.0, 0.01 * 2**attempt))
        raise CommitConflict(f"gave up after {TRIES} tries")

    # runs

    def stage(self, rows: DataFrame, batch: str | None = None) -> list[Run]:
        """Writes rows as runs that no manifest lists yet, one for each value of the int column batch, all in one pass."""
        own = _free("__batch", rows.columns)
        rows = rows.withColumn(own, F.lit(0)) if batch is None else rows.withColumnRenamed(batch, own)
        folder = f"run-{uuid.uuid4().hex}"
        rows.write.partitionBy(own).parquet(f"{self.root}/{folder}")
        names = [x.getPath().getName() for x in self._status(f"{self.root}/{folder}") if x.getPath().getName().startswith(f"{own}=")]
        if not names:
            return []
        counts = self.spark.read.schema(f"`{own}` int").parquet(f"{self.root}/{folder}").groupBy(own).count().collect()  # a row a batch, from the footers
        found = {}
        for name in names:
            sizes = [x.getLen() for x in self._status(f"{self.root}/{folder}/{name}") if x.getPath().getName().endswith(".parquet")]
            found[int(name.partition("=")[2])] = (f"{folder}/{name}", sum(sizes), len(sizes))
        return [Run(found[r[own]][0], r["count"], *found[r[own]][1:]) for r in sorted(counts, key=lambda r: r[own])]

    def append(self, arrivals: DataFrame) -> int:
        """A new run of the arrivals' rows, one shard a partition; the new version."""
        return self.publish(self.stage(arrivals))

    def publish(self, staged: list[Run]) -> int:
        """Lists staged runs; the new version."""
        return self._publish_change(lambda runs: [*runs, *staged])

    def read_runs(self, runs: list[Run], schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/{r.name}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, schema: T.StructType) -> int | None:
        """Merges the lowest full tier; the new version, or None if there is none or another writer has replaced one of its runs."""
        full = full_tier(self.manifest()[1], self.target_bytes, self.fan_in)
        if not full:
            return None
        n = max(1, round(sum(r.bytes for r in full) / self.target_bytes))
        merged = self.stage(self.read_runs(full, schema).coalesce(n))
        version = self._publish_change(lambda runs: [*(r for r in runs if r not in full), *merged] if set(full) <= set(runs) else None)
        if version is None:
            self._remove(r.name for r in merged)
        return version

    def settle(self, schema: T.StructType, retention_s: float = RETENTION_S) -> int:
        """Compacts until no tier is full, removing what has been replaced; the version then."""
        while self.compact(schema) is not None:
            self.vacuum(retention_s)
        return self.manifest()[0]

    def _remove(self, names) -> None:
        for name in names:
            path = self._path(f"{self.root}/{name}")
            self._fs.delete(path, True)
            if self._fs.exists(path.getParent()) and not any(x.isDirectory() for x in self._fs.listStatus(path.getParent())):
                self._fs.delete(path.getParent(), True)

    def vacuum(self, retention_s: float = RETENTION_S, grace_s: float = GRACE_S) -> None:
        """Removes runs replaced retention_s ago (readers of older versions must be done), and leftovers older than grace_s."""
        now, versions = time.time(), self.versions()
        if not versions:
            return
        known = {v: {r.name for r in self.manifest(v)[1]} for v in versions}
        live, listed, replaced, over = known[versions[-1]], set(), set(), []
        for old, new in zip(versions[:-1], versions[1:], strict=True):
            listed |= known[old]
            if now - self._fs.getFileStatus(self._path(self._manifest_path(new))).getModificationTime() / 1000 >= retention_s:
                replaced |= known[old] - known[new]
                replaced_s = now - self._fs.getFileStatus(self._path(self._manifest_path(new))).getModificationTime() / 1000
                over += [old] if replaced_s >= max(retention_s, grace_s) else []
        self._remove(n for n in replaced - live if self._fs.exists(self._path(f"{self.root}/{n}")))
        for old in over:  # no reader needs a version replaced so long ago, and the next vacuum needn't read it
            self._fs.delete(self._path(self._manifest_path(old)), False)
        folders = {n.partition("/")[0] for n in live | listed}
        for x in self._status(self.root):
            name = x.getPath().getName()
            if name.startswith("run-") and name not in folders and now - x.getModificationTime() / 1000 >= grace_s:
                self._fs.delete(x.getPath(), True)

    def read(self, schema: T.StructType) -> DataFrame:
        """All rows of the latest version, with shard (its file), version and tier of its run."""
        version, runs = self.manifest()
        rows = self.read_runs(runs, schema)
        names = [c for c in rows.columns if c not in ("shard", "version", "tier")]
        if not runs:
            return rows.select(*names, F.lit("").alias("shard"), F.lit(version).alias("version"), F.lit(0).alias("tier"))
        parts = F.split(F.col("_metadata.file_path"), "/")
        run = _free("__run", rows.columns)
        place = {run: F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2)), "shard": F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2), F.element_at(parts, -1))}
        tiers = self.spark.createDataFrame([(r.name, r.tier) for r in runs], f"`{run}` string, tier int")
        if len(runs) <= MOST_BROADCAST_RUNS:
            tiers = F.broadcast(tiers)  # about 100 bytes a run, so 10 MB at most; with more runs Spark chooses
        return rows.select(*names, *(c.alias(n) for n, c in place.items())).join(tiers, run).select(*names, "shard", F.lit(version).alias("version"), "tier")


def shard_by_arrival(docs: DataFrame, root: str, key: str = "doc_id", arrivals: int = 4, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """docs taken as arrivals batches (by a hash of the id), each appended to a new store and compacted; the store's rows.

    All batches are written in one pass over docs, and listed one after the other. The store is this call's own, so runs
    are removed as soon as they are replaced.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, fan_in)
    batch = _free("__arrival", docs.columns)
    for run in store.stage(docs.withColumn(batch, F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int")), batch):
        store.publish([run])
        store.settle(docs.schema, retention_s=0)
    return store.read(docs.schema)
