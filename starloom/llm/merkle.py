"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources' roots, and each row's proof.

A node is the SHA-256, in hex, of its children's digests joined. Sixteen consecutive nodes have one parent; a last run may be
shorter, and even one node alone is hashed once more while others stand beside it on its level.

Leaves are hashed by Spark's own functions, ordered by ranges and numbered. Blocks of 16 ** LIFT consecutive nodes are then
reduced in one task each, all blocks in parallel, and so again until at most TOP nodes are left, whatever the number of
rows. This small top tree is gathered and built by the driver, which broadcasts each of its nodes' path to the root: TOP
rows of a path each at most. Executors put a block's own levels in front of the path that its first row carries, and finish
each row's proof and fold. Where there are more than TOP sources, their roots are leaves of a tree that is reduced in the
same way.

A null source is a source of its own, the first. Null columns are ``-``, unlike the text ``-``. Rows of one id stand in
order of their digests; rows alike in every column stand side by side and have proofs of their own. A null id comes first.
Empty and very long texts are hashed whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, ascii_lower, key_runs

FAN_IN, LIFT, TOP = 16, 3, 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_hash(**instead: Column) -> Column:
    """The hash of a row's columns, each with its length in front, so that no two rows are written alike."""
    parts = []
    for c in COLUMNS:
        value = instead.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tried: the leaf of what is to be verified, which is not the row's own where the id's
    checksum is divisible by five."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tried = F.when(tampered, leaf_hash(text=ascii_lower(F.col("text")))).otherwise(leaf_hash())
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_hash().alias("leaf"), tried.alias("tried"))


def numbered(rows: DataFrame, tree: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """rows with idx, their place among the rows of their tree, and n, the number of these. No task sees a whole tree."""
    dealt = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    names = [*rows.columns, "range", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            places = []
            for key in zip(*(batch.column(c).to_pylist() for c in tree), strict=True) if tree else [()] * len(batch):
                at = at + 1 if key == last else 0
                last = key
                places.append(at)
            columns = [*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    table = scratch.write(dealt.mapInArrow(run, f"{fields}, range int, place long"), "numbered")
    sizes = table.groupBy(*tree, "range").agg(F.count(F.lit(1)).alias("rows"))
    own = W.partitionBy(*tree) if tree else W.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("rows").over(own.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("rows").over(own)})
    t, s = table.alias("t"), scratch.write(sizes, "ranges").alias("s")
    same = F.col("t.range") == F.col("s.range")
    for c in tree:
        same &= F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    out = t.join(s, same).select(*(f"t.{c}" for c in rows.columns), (F.col("place") + F.col("before")).alias("idx"), "n")
    return scratch.write(out, "indexed")


def height(n: int, fan_in: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_in), levels + 1
    return levels


def raised(digests: list[str], fan_in: int) -> list[str]:
    """The next level."""
    return [digest("".join(digests[i : i + fan_in])) for i in range(0, len(digests), fan_in)]


def paths(digests: list[str], levels: int, fan_in: int) -> tuple[list[str], list[str]]:
    """The path of each node over so many levels, and the nodes that these end in. A level of a path is ``left.right;``:
    the joined digests beside the node."""
    out = [""] * len(digests)
    width, level = 1, digests
    for _ in range(levels):
        for i in range(len(level)):
            run, at = level[i // fan_in * fan_in : i // fan_in * fan_in + fan_in], i % fan_in
            step = f"{''.join(run[:at])}.{''.join(run[at + 1 :])};"
            for j in range(i * width, min((i + 1) * width, len(out))):
                out[j] += step
        width, level = width * fan_in, raised(level, fan_in)
    return out, level


def fold(node: str, path: str) -> str:
    """The root that a node leads to."""
    for step in path.split(";")[:-1]:
        left, right = step.split(".")
        node = digest(left + node + right)
    return node


def proof_digest(path: str) -> str:
    """The hash of all digests of a path, level by level."""
    return digest(path.replace(".", "").replace(";", ""))


class _Shape:
    def __init__(self, fan_in: int, lift: int, top: int):
        self.fan_in, self.lift, self.top, self.block = fan_in, lift, top, fan_in**lift


_NODES = "tree string, idx long, n long, node string"


def _blocks(nodes: DataFrame, shape: _Shape) -> DataFrame:
    nodes = nodes.withColumn("block", F.floor(F.col("idx") / shape.block).cast("long"))
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def lifted(nodes: DataFrame, shape: _Shape) -> DataFrame:
    """The nodes that stand LIFT levels higher, or at the top of lower trees. A task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = defaultdict(list)
        for table in key_runs(batches, ["tree", "block"]):
            n, level = table.column("n")[0].as_py(), table.column("node").to_pylist()
            up = min(shape.lift, height(n, shape.fan_in))
            for _ in range(up):
                level, n = raised(level, shape.fan_in), -(-n // shape.fan_in)
            for name, value in (("tree", table.column("tree")[0].as_py()), ("idx", table.column("block")[0].as_py()), ("n", n), ("node", level[0])):
                out[name].append(value)
            if len(out["n"]) >= 4096:
                yield _nodes(out)
                out = defaultdict(list)
        if out:
            yield _nodes(out)

    return _blocks(nodes, shape).mapInArrow(run, _NODES)


def _nodes(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds], [c for c, _ in kinds])


def climbed(nodes: DataFrame, shape: _Shape, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, int]:
    """The tables of nodes on the way up, one at least, and those that are left: at most TOP, or the root of every tree; and their number."""
    stages: list[DataFrame] = []
    while True:
        stages.append(nodes)
        nodes = scratch.write(lifted(nodes, shape), "nodes")
        count = nodes.count()
        if count <= shape.top or nodes.where("n > 1").isEmpty():
            return stages, nodes, count


def top_paths(rows: list, shape: _Shape) -> tuple[list[tuple], str]:
    """The driver's part. Nodes (tree, idx, n, node), at most TOP, to (tree, idx, path to the root, root of the tree), and the root."""
    trees: dict[str | None, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.tree is not None, (r.tree or "").encode(), r.idx)):
        trees[r.tree].append(r)
    own = {t: paths([r.node for r in rs], height(len(rs), shape.fan_in), shape.fan_in) for t, rs in trees.items()}
    subroots = [level[0] for _, level in own.values()]
    above, root = paths(subroots, height(len(subroots), shape.fan_in), shape.fan_in)
    out = []
    for (tree, rs), sub, up in zip(trees.items(), subroots, above, strict=True):
        out += [(tree, r.idx, path + up, sub) for r, path in zip(rs, own[tree][0], strict=True)]
    return out, root[0]


_PATHS = "tree string, idx long, path string, subroot string"


def descended(nodes: DataFrame, above: DataFrame, shape: _Shape, bounded: bool) -> DataFrame:
    """nodes, each block with the path and subroot of its parent node (tree, idx, path, subroot) in its first row, sorted."""
    first = nodes.withColumn("block", F.floor(F.col("idx") / shape.block).cast("long"))
    n, a = first.alias("n"), (F.broadcast(above) if bounded else above).alias("a")
    meets = F.col("n.tree").eqNullSafe(F.col("a.tree")) & (F.col("n.block") == F.col("a.idx")) & (F.col("n.idx") % shape.block == 0)
    met = n.join(a, meets, "left").select(*(f"n.{c}" for c in first.columns), F.col("a.path").alias("path"), F.col("a.subroot").alias("subroot"))
    return met.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def block_paths(batches: Iterator[pa.RecordBatch], shape: _Shape) -> Iterator[tuple[pa.Table, list[str], str]]:
    """Of descended() rows: each block, the paths of its nodes to the root, and their subroot."""
    for table in key_runs(batches, ["tree", "block"]):
        levels = min(shape.lift, height(table.column("n")[0].as_py(), shape.fan_in))
        own, _ = paths(table.column("node").to_pylist(), levels, shape.fan_in)
        yield table, [p + table.column("path")[0].as_py() for p in own], table.column("subroot")[0].as_py()


def _handed_down(nodes: DataFrame, above: DataFrame, shape: _Shape, bounded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, path, subroot in block_paths(batches, shape):
            columns = [table.column("tree").combine_chunks(), table.column("idx").combine_chunks(), pa.array(path, pa.string()), pa.array([subroot] * len(path), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "path", "subroot"])

    return descended(nodes, above, shape, bounded).mapInArrow(run, _PATHS)


def manifest(docs: DataFrame, fan_in: int = FAN_IN, lift: int = LIFT, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a document."""
    spark, shape = docs.sparkSession, _Shape(fan_in, lift, top)
    scratch = Scratch(spark, "merkle")
    rows = numbered(scratch.write(leaves(docs), "leaves"), ["source"], ["doc_id", "leaf"], scratch)  # texts are read once
    nodes = rows.select(F.col("source").alias("tree"), "idx", "n", F.col("leaf").alias("node"), "doc_id", "tried")
    stages, tops, count = climbed(nodes.select("tree", "idx", "n", "node"), shape, scratch)
    if count <= top:
        found, root = top_paths(tops.collect(), shape) if count else ([], "")
        above, bounded = spark.createDataFrame(found, _PATHS), True
    else:  # more sources than the driver should hold: their roots are leaves in turn
        roots = numbered(tops.select("tree", "node"), [], ["tree"], scratch).withColumn("source", F.col("tree"))
        higher = roots.select(F.lit(None).cast("string").alias("tree"), "idx", "n", "node")
        more, last, _ = climbed(higher, shape, scratch)
        found, root = top_paths(last.collect(), shape)
        paths_, bounded = spark.createDataFrame(found, _PATHS), True
        for stage in reversed(more):
            paths_, bounded = scratch.write(_handed_down(stage, paths_, shape, bounded), "paths"), False
        above = roots.select("source", "idx", "node").join(paths_.select("idx", "path"), "idx")
        above, bounded = scratch.write(above.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot")), "source-paths"), False
    for stage in reversed(stages[1:]):
        above, bounded = scratch.write(_handed_down(stage, above, shape, bounded), "paths"), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, path, subroot in block_paths(batches, shape):
            folded = [fold(t, p) for t, p in zip(table.column("tried").to_pylist(), path, strict=True)]
            columns = [pa.array(x, pa.string()) for x in ([subroot] * len(path), [proof_digest(p) for p in path], folded)]
            same = pa.array([f == root for f in folded], pa.bool_())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("node").combine_chunks(), *columns, same], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "verified"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = descended(nodes, above, shape, bounded).mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")
