"""Near-duplicate embeddings by lattice hashing.

A vector's direction is projected at random to BLOCKS times eight dimensions and each eight are decoded to the nearest point
of the E8 lattice; the points together are the vector's cell. This is done in TABLES tables with their own projections and
shifts. Besides its own cell, a vector looks into the PROBES neighbouring cells that lie nearest to it (one of E8's 240
shortest vectors away in one to three of the blocks). Two vectors meet where one lies in a cell that the other lies in or
looks into; all that meet are compared by cosine in double precision.

Of two vectors at a cosine of just 0.95, a table lets 0.51 meet, so that sixteen miss about one in a hundred thousand; nearer
ones are missed far less often (0.98: under one in 10 ** 11). Two vectors that have nothing in common meet in about seven of
100,000 cases, so that of a million each is compared with some seventy; raise ``blocks`` and ``tables`` beyond ten million.

Vectors that are alike in every component are one node with a count. Cells that hold one vector only are left out. A cell
with more than CHUNK vectors is cut into chunks, and each pair of chunks is a task's work of its own, a product of two small
matrices; what leaves the task is each vector's number of links and a spanning forest, never the pairs. A pair that meets in
several cells counts in the first of them.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; they and vectors of another
length are compared with no other. Rows that repeat are links of one another. A null id is no component's id unless the
component has no other. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, U, key_runs, mix
from starloom.llm.near_dedup import components

COSINE = 0.95
TABLES, BLOCKS, PROBES = 16, 4, 8
#: Lattice cells are as wide as 1 / SPREAD standard deviations of a unit vector's coordinate, times eight.
SPREAD = 0.34
CHUNK = 1024
_NEAREST, _SLAB = 8, 1 << 15


def _shortest() -> np.ndarray:
    """E8's 240 shortest vectors."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


SHORTEST = _shortest()


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole coordinates of an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=256)
def _projection(dim: int, table: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, shift and the odd factors that hash a cell."""
    rng = np.random.default_rng([dim, table, blocks])
    m = rng.normal(size=(dim, 8 * blocks))
    m = np.linalg.qr(m)[0] * np.sqrt(dim) if dim >= 8 * blocks else m
    return m * SPREAD, rng.uniform(0, 1, 8 * blocks), rng.integers(1, 1 << 62, 8 * blocks, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=8)
def _steps(blocks: int) -> list[tuple[tuple[int, int], ...]]:
    """Ways to a neighbouring cell: (block, which of its nearest points), in one block, two or three."""
    out = [((b, m),) for b in range(blocks) for m in range(_NEAREST)]
    out += [((b, m), (c, k)) for b, c in itertools.combinations(range(blocks), 2) for m in range(4) for k in range(4)]
    return out + [tuple((b, 0) for b in bs) for bs in itertools.combinations(range(blocks), 3)]


def cells(x: np.ndarray, table: int, blocks: int = BLOCKS, probes: int = PROBES) -> np.ndarray:
    """Hashes of unit vectors' cells in a table: their own and the nearest others, one row a vector."""
    m, shift, factors = _projection(x.shape[1], table, blocks)
    y = x @ m + shift
    points, costs, which = [], [], []
    for b in range(blocks):
        part = y[:, 8 * b : 8 * b + 8]
        point = e8(part)
        further = 2 - 2 * (part - point) @ SHORTEST.T  # the squared distance of each neighbour, less that of the point
        near = np.argpartition(further, _NEAREST, 1)[:, :_NEAREST]
        cost = np.take_along_axis(further, near, 1)
        order = cost.argsort(1, kind="stable")
        points.append(point)
        costs.append(np.take_along_axis(cost, order, 1))
        which.append(np.take_along_axis(near, order, 1))
    steps = _steps(blocks)
    total = np.stack([sum(costs[b][:, k] for b, k in step) for step in steps], 1)
    best = total.argsort(1, kind="stable")[:, :probes]
    doubled = (2 * np.concatenate(points, 1)).astype(np.int64).view(np.uint64)
    home = (doubled * factors).sum(1, dtype=np.uint64)
    move = [(2 * SHORTEST).astype(np.int64).view(np.uint64) @ factors[8 * b : 8 * b + 8] for b in range(blocks)]
    out = np.repeat(home[:, None], 1 + best.shape[1], 1)
    for i, step in enumerate(steps):
        row, column = np.nonzero(best == i)
        for b, k in step:
            out[row, column + 1] += move[b][which[b][row, k]]
    return mix(out ^ mix(np.full(1, (x.shape[1] << 20) + table + 1, np.uint64)))


def units(rows: pa.Array) -> np.ndarray:
    """Directions of vectors of one length, in double precision, whatever their size."""
    x = np.array(rows.to_pylist(), np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and directions of the vectors of each length."""
    length = np.array([len(x) for x in column.to_pylist()], np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, units(column.take(pa.array(at)))


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def in_cells(nodes: DataFrame, tables: int, blocks: int, probes: int) -> DataFrame:
    """(node, embedding) to (cell, node, home): the cells that a vector lies in or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                node = part.column("node").to_numpy()
                for at, x in _by_length(part.column("embedding")):
                    for t in range(tables):
                        own = cells(x, t, blocks, probes)
                        home = np.zeros(own.shape, bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array(own.ravel().view(np.int64)), pa.array(np.repeat(node[at], own.shape[1])), pa.array(home.ravel())], ["cell", "node", "home"])

    return nodes.select("node", "embedding").mapInArrow(run, "cell long, node long, home boolean")


def with_cells(nodes: DataFrame, tables: int, blocks: int, probes: int) -> DataFrame:
    """(node, copies, embedding) to (node, copies, unit, own): the direction and all cells as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                for at, x in _by_length(part.column("embedding")):
                    own = np.concatenate([cells(x, t, blocks, probes) for t in range(tables)], 1)
                    some = part.select(["node", "copies"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in own], pa.binary())], ["node", "copies", "unit", "own"])

    return nodes.mapInArrow(run, "node long, copies long, unit binary, own binary")


def first_meeting(a: np.ndarray, b: np.ndarray, a_first: np.ndarray) -> np.ndarray:
    """The first cell in which each pair of vectors meets, by their cells (pairs, tables, 1 + probes): the first table's;
    in it the cell of both, or else that of the first of the two, or else that of the other."""
    out = np.zeros(len(a), np.uint64)
    open_ = np.ones(len(a), bool)
    for t in range(a.shape[1]):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        home_a, home_b = a[i, t, 0], b[i, t, 0]
        in_b, in_a = (b[i, t] == home_a[:, None]).any(1), (a[i, t] == home_b[:, None]).any(1)
        met = in_a | in_b
        use_a = np.where(a_first[i], in_b, ~in_a)
        out[i[met]] = np.where(use_a, home_a, home_b)[met]
        open_[i[met]] = False
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each of n connected components, by labels passed along links and shortcut."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compared(members: DataFrame, threshold: float, tables: int, chunk: int) -> DataFrame:
    """Rows (cell, node, home, chunks, copies, unit, own) to (node, other, links): of each cell's vectors the number of links
    that are met there first, and a vector that it is connected with."""
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    last = F.col("chunks") - 1
    halves = F.when(F.col("chunks") > 1, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("mine", mine).withColumn("theirs", F.explode(halves))
    dealt = dealt.withColumns({"low": F.least("mine", "theirs"), "high": F.greatest("mine", "theirs")}).drop("chunks", "theirs")
    dealt = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, ["cell", "low", "high"]):
            if len(table) < 2:
                continue
            node, copies, home, mine = (table.column(c).to_numpy() for c in ("node", "copies", "home", "mine"))
            cell = np.int64(table.column("cell")[0].as_py()).view(np.uint64)
            split = table.column("low")[0].as_py() != table.column("high")[0].as_py()
            x = [np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()]
            if len({len(v) for v in x}) > 1:  # lengths never share a cell but by a chance of their hashes
                continue
            x = np.stack(x)
            own = np.stack([np.frombuffer(c, np.uint64) for c in table.column("own").to_pylist()]).reshape(len(node), tables, -1)
            links = np.zeros(len(node), np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            step = max(1, _SLAB // len(node))
            for start in range(0, len(node), step):
                stop = min(start + step, len(node))
                near = x[start:stop] @ x.T >= threshold
                near &= np.arange(start, stop)[:, None] < np.arange(len(node))
                near &= home[start:stop, None] | home
                if split:
                    near &= mine[start:stop, None] != mine
                a, b = np.nonzero(near)
                a = a + start
                found.append((a, b))
                first = first_meeting(own[a], own[b], np.ones(len(a), bool)) == cell
                np.add.at(links, a[first], copies[b[first]])
                np.add.at(links, b[first], copies[a[first]])
            a, b = (np.concatenate(v) for v in zip(*found, strict=True))
            if len(a):
                root = _roots(len(node), a, b)
                some = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], ["node", "other", "links"])

    return dealt.mapInArrow(run, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row a vector."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    id_, v = F.col(key).cast("long").alias("vec_id"), F.col(vector)
    rows = vectors.select(id_, F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(7), v).alias("k2"), comparable(v).alias("valid"), v.alias("embedding"))
    same = rows.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    nodes = scratch.write(same.withColumn("node", F.monotonically_increasing_id()), "nodes")

    entries = scratch.write(in_cells(nodes, tables, blocks, probes), "cells")
    shared = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("met"), F.max("home").alias("lived")).where("met > 1 AND lived")
    shared = scratch.write(shared.select("cell", F.ceil(F.col("met") / chunk).cast("int").alias("chunks")), "shared-cells")
    members = scratch.write(entries.join(shared, "cell"), "members")
    scratch.drop(entries, shared)
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "copies", "embedding")
    own = scratch.write(with_cells(chosen, tables, blocks, probes), "directions")
    found = scratch.write(compared(members.join(own, "node"), threshold, tables, chunk), "links")
    scratch.drop(members, own)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    of_node = nodes.select("k1", "k2", "node", "least", "copies").join(labels, "node", "left").join(links, "node", "left")
    of_node = scratch.write(of_node.select("k1", "k2", "least", F.coalesce("cls", "node").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "of-node")
    least = scratch.write(of_node.groupBy("cls").agg(F.min("least").alias("component_id")), "components")
    result = scratch.write(of_node.join(least, "cls").select("k1", "k2", "n_links", "component_id"), "result")
    scratch.keep_only(result)
    out = rows.drop("embedding").join(result.withColumn("valid", F.lit(True)), ["k1", "k2", "valid"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
