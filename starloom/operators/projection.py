"""Frames on the cells of the sky: which cells a footprint touches, a frame's values on a cell's own pixels, and each frame's share in each cell.

A frame is given by its pixels (frame, y, x, value) and a row of its geometry: ra, dec, x0, y0, sx, sy (gnomonic, degrees a
pixel), height, width and weight. A cell's own pixels are the cells so many orders below it, in their nested order, so every
one of them truly lies in the cell.

The edges of a gnomonic image are great circles, so its footprint is a convex polygon on the sphere. The cells it touches
are found from the twelve base cells down: a cell whose centre is farther outside of an edge than the cell reaches is left
out, one that is so far inside of all edges is taken with all that it holds, and the others are cut into four.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.maths import cosd, rev, sind
from starloom.operators.raster import seen
from starloom.sources.storage import written

DEPTH, BLOCK = 9, 64
GEOMETRY = ("ra", "dec", "x0", "y0", "sx", "sy", "height", "width", "weight")


def sky_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel to position, by the geometry columns of the row."""
    c = F.col
    u, v = F.radians((x - c("x0")) * c("sx")), F.radians((y - c("y0")) * c("sy"))
    down = cosd(c("dec")) - v * sind(c("dec"))
    return rev(c("ra") + F.degrees(F.atan2(u, down))), F.degrees(F.atan2(sind(c("dec")) + v * cosd(c("dec")), F.sqrt(u * u + down * down)))


def pixel_of(ra: np.ndarray, dec: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Position to pixel, by arrays of the geometry; NaN on the far side of the sky."""
    a, dec, d0 = np.radians(ra - g["ra"]), np.radians(dec), np.radians(g["dec"])
    deep = np.sin(dec) * np.sin(d0) + np.cos(dec) * np.cos(d0) * np.cos(a)
    deep = np.where(deep > 0, deep, np.nan)
    u = np.degrees(np.cos(dec) * np.sin(a) / deep)
    v = np.degrees((np.sin(dec) * np.cos(d0) - np.cos(dec) * np.sin(d0) * np.cos(a)) / deep)
    return u / g["sx"] + g["x0"], v / g["sy"] + g["y0"]


def _edges(polygons: DataFrame) -> DataFrame:
    """(frame, edges): for each edge of a polygon the unit normal of its great circle, towards the inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for corners in batch.column("corners").to_pylist():
                ra, dec = np.radians([[c["ra"], c["dec"]] for c in corners]).T
                v = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)
                normal = np.cross(v, np.roll(v, -1, 0))
                normal /= np.linalg.norm(normal, axis=1)[:, None]
                out.append((normal * np.sign(normal[0] @ v.mean(0))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["frame", "edges"])

    return polygons.select("frame", "corners").mapInArrow(run, f"frame {polygons.schema['frame'].dataType.simpleString()}, edges array<array<double>>")


def footprints(frames: DataFrame) -> DataFrame:
    """(frame, corners): the four outer corners of each frame's pixels, as struct(ra, dec)."""
    low, right, top = F.lit(-0.5), F.col("width") - 0.5, F.col("height") - 0.5
    corners = [F.struct(*(c.alias(n) for c, n in zip(sky_of(x, y), ("ra", "dec"), strict=True))) for x, y in ((low, low), (right, low), (right, top), (low, top))]
    return frames.select("frame", F.array(*corners).alias("corners"))


def footprint_rings(frames: DataFrame, samples: int = 16) -> DataFrame:
    """(frame, n, ra, dec, continuous_ra): positions along each frame's edges, closed, with right ascension unwrapped along the ring."""
    n, t = F.col("n"), F.col("n") % samples / samples
    edge = F.floor(n / samples) % 4
    x = F.when(edge == 0, t).when(edge == 1, 1.0).when(edge == 2, 1 - t).otherwise(0.0) * (F.col("width") - 1)
    y = F.when(edge == 0, 0.0).when(edge == 1, t).when(edge == 2, 1.0).otherwise(1 - t) * (F.col("height") - 1)
    rows = frames.select("frame", *GEOMETRY, F.explode(F.sequence(F.lit(0), F.lit(4 * samples))).alias("n")).withColumns({"px": x, "py": y})
    ra, dec = sky_of(F.col("px"), F.col("py"))
    ring = rows.select("frame", "n", ra.alias("ra"), dec.alias("dec"))
    turn = W.partitionBy("frame").orderBy("n")
    jump = F.col("ra") - F.lag("ra").over(turn)
    ring = ring.withColumn("wrap", F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0))
    return ring.select("frame", "n", "ra", "dec", (F.col("ra") + F.sum("wrap").over(turn)).alias("continuous_ra"))


def polygon_cover(polygons: DataFrame, order: int) -> DataFrame:
    """(frame, order, index, inside): the cells that convex polygons (frame, corners in turn) touch.

    inside cells lie in the polygon as a whole and may be of any order up to the one given; the others are of that order and
    may lie across an edge, or just outside by less than a cell. A cell of order o stands for the interval of indices
    index * 4 ** (order - o) and on. No cell comes twice.
    """
    kind = polygons.schema["frame"].dataType.simpleString()
    rows = written(_edges(polygons), "edges")
    left = rows.select("frame", "edges", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("index"))
    found = []
    levels = [*range(0, order, 2), order]  # two orders at a time: half as many rounds
    for last, o in zip([0, *levels], levels, strict=False):
        if o:
            left = left.select("frame", "edges", F.explode(F.sequence(F.col("index") * 4 ** (o - last), (F.col("index") + 1) * 4 ** (o - last) - 1)).alias("index"))
        reach = float(np.sin(np.radians(min(90.0, H.widest_radius(o) if o else 60.0))))  # a base cell reaches less than 60 degrees
        centre = H.with_centre(left, "index", o).select("frame", "edges", "index", "centre_ra", "centre_dec")
        met = written(centre.mapInArrow(partial(_met, reach=reach), f"frame {kind}, edges array<array<double>>, index long, inside boolean"), "cover")
        out = met.where("inside") if o < order else met
        found.append(out.select("frame", F.lit(o).alias("order"), "index", "inside"))
        left = met.where("NOT inside").select("frame", "edges", "index")
    cover = found[0]
    for more in found[1:]:
        cover = cover.unionByName(more)
    return cover


def _met(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Rows whose cell may touch the polygon, with whether it lies inside: by how far its centre is inside of every edge."""
    for batch in batches:
        if not len(batch):
            continue
        ra, dec = (np.radians(batch.column(c).to_numpy()) for c in ("centre_ra", "centre_dec"))
        centre = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)
        n = pc.list_value_length(batch.column("edges")).to_numpy()
        edges = batch.column("edges").flatten().flatten().to_numpy().reshape(-1, 3)
        depth = np.minimum.reduceat((edges * np.repeat(centre, n, 0)).sum(1), np.cumsum(n) - n)
        kept = batch.select(["frame", "edges", "index"]).append_column("inside", pa.array(depth > reach))
        yield kept.filter(pa.array(depth >= -reach))


def cells_touched(cover: DataFrame, cells: DataFrame) -> DataFrame:
    """(frame, order, index): the cells of a table (order, index) that a cover's intervals touch.

    Intervals of nested cells touch only where one holds the other. So a pair meets as an equality of an index with an
    ancestor's, once for the orders above the cover's and once for those below.
    """
    orders = cells.select("order").distinct().withColumnRenamed("order", "o")
    up = lambda index, levels: F.expr(f"shiftright({index}, 2 * ({levels}))")
    # the cell holds the cover's: as many rows as there are orders, which are few
    above = cover.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("order")))).join(F.broadcast(orders), "o").select("frame", F.col("o").alias("order"), up("index", "`order` - o").alias("index")).distinct()
    held = above.join(cells, ["order", "index"], "left_semi")
    below = cells.select("order", "index", F.explode(F.sequence(F.lit(0), F.col("order") - 1)).alias("o")).where("o < `order`")
    below = below.select("order", "index", "o", up("index", "`order` - o").alias("root"))
    inner = cover.select("frame", F.col("order").alias("o"), F.col("index").alias("root")).join(below, ["o", "root"]).select("frame", "order", "index")
    return held.unionByName(inner).distinct()


def _kernel(t: np.ndarray) -> np.ndarray:
    """Weights of four neighbours at -1, 0, 1, 2 for a place t between the middle two: cubic convolution, a = -1/2."""
    d = np.stack([t + 1, t, 1 - t, 2 - t], -1)
    near = (1.5 * d - 2.5) * d * d + 1
    far = ((-0.5 * d + 2.5) * d - 4) * d + 2
    return np.where(d <= 1, near, far)


def _interpolated(image: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Bicubic values at places (v, u) of an array, NaN where one of the sixteen neighbours is masked."""
    y, x = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
    ys, xs = y[:, None] + np.arange(-1, 3), x[:, None] + np.arange(-1, 3)
    patch = image[ys[:, :, None], xs[:, None, :]]
    return np.einsum("nij,ni,nj->n", patch, _kernel(v - y), _kernel(u - x))


def _blocks(pixels: DataFrame, block: int) -> DataFrame:
    """Pixels by block of a frame, each with the rim of its neighbours that its kernels reach."""
    y, x = F.col("y"), F.col("x")
    spots = lambda c: F.array_distinct(F.array(F.floor((c - 2) / block), F.floor(c / block), F.floor((c + 1) / block)))
    rows = pixels.where(seen()).withColumn("by", F.explode(spots(y))).withColumn("bx", F.explode(spots(x)))
    return rows.select("frame", "by", "bx", "y", "x", "value")


def projected(pixels: DataFrame, frames: DataFrame, touched: DataFrame, order: int, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(frame, index, z, value): the values of frames on the pixels of the cells (frame, index) of an order that they touch.

    z is the pixel's nested place in its cell, of 4 ** depth. Values are bicubic; a pixel is there only if all sixteen
    neighbours are. Pixels go to their place's block of the frame, which holds its rim: a task has one block of a frame.
    """
    fine = order + depth
    asked = touched.select("frame", "index").join(frames.select("frame", *GEOMETRY), "frame")
    asked = asked.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4**depth - 1).cast("long"))))
    asked = H.with_centre(asked.withColumn("fine", F.col("index") * 4**depth + F.col("z")), "fine", fine)
    kind = pixels.schema["frame"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those with all neighbours inside of the frame, and their places in it."""
        for batch in batches:
            g = {c: batch.column(c).to_numpy().astype(np.float64) for c in GEOMETRY}
            u, v = pixel_of(batch.column("centre_ra").to_numpy(), batch.column("centre_dec").to_numpy(), g)
            at = np.flatnonzero((u >= 1) & (v >= 1) & (u < g["width"] - 2) & (v < g["height"] - 2))
            kept = batch.select(["frame", "index", "z"]).take(pa.array(at))
            spots = [pa.array(np.floor(c[at] / block).astype(np.int64)) for c in (v, u)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *spots, pa.array(v[at]), pa.array(u[at])], ["frame", "index", "z", "by", "bx", "v", "u"])

    asked = asked.select("frame", "index", "z", "centre_ra", "centre_dec", *(F.col(c).cast("double").alias(c) if c not in ("ra", "dec") else F.col(c) for c in GEOMETRY))
    asked = asked.mapInArrow(place, f"frame {kind}, index long, z long, by long, bx long, v double, u double")

    def run(asked_: pa.Table, block_: pa.Table) -> pa.Table:
        image = np.full((block + 3, block + 3), np.nan)
        if len(asked_):
            top, left = asked_.column("by")[0].as_py() * block - 1, asked_.column("bx")[0].as_py() * block - 1
            image[block_.column("y").to_numpy() - top, block_.column("x").to_numpy() - left] = block_.column("value").to_numpy()
            values = _interpolated(image, asked_.column("v").to_numpy() - top, asked_.column("u").to_numpy() - left)
        else:
            values = np.empty(0)
        out = asked_.select(["frame", "index", "z"]).append_column("value", pa.array(values, pa.float64()))
        return out.filter(pa.array(np.isfinite(values)))

    blocks = _blocks(pixels, block)
    keys = ["frame", "by", "bx"]
    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, f"frame {kind}, index long, z long, value double")


def source_shares(values: DataFrame, frames: DataFrame, order: int, depth: int = DEPTH) -> DataFrame:
    """(order, index, frame, finite_pixels, cell_pixels, coverage, weighted_pixels, share) of projected values: each frame's part in each cell.

    The shares of a cell add up to 1.
    """
    counts = values.groupBy("index", "frame").agg(F.count(F.lit(1)).alias("finite_pixels")).join(frames.select("frame", "weight"), "frame")
    counts = counts.withColumn("weighted_pixels", F.col("finite_pixels") * F.col("weight")).where("weighted_pixels > 0")
    total = counts.groupBy("index").agg(F.sum("weighted_pixels").alias("total"))
    cells = F.lit(4**depth).cast("long")
    return counts.join(total, "index").select(F.lit(order).alias("order"), "index", "frame", "finite_pixels", cells.alias("cell_pixels"), (F.col("finite_pixels") / cells).alias("coverage"), "weighted_pixels", (F.col("weighted_pixels") / F.col("total")).alias("share"))


def share_problems(shares: DataFrame, frames: DataFrame, cells: DataFrame) -> DataFrame:
    """(problem, frame, index): frames of the inventory that reach no cell or have no good weight, and cells that no frame reaches."""
    bad = frames.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0) | (F.col("weight") == float("inf")))
    idle = frames.join(shares.select("frame").distinct(), "frame", "left_anti").join(bad.select("frame"), "frame", "left_anti")
    empty = cells.join(shares.select("order", "index").distinct(), ["order", "index"], "left_anti")
    kind = frames.schema["frame"].dataType
    none = F.lit(None)
    return (
        bad.select(F.lit("weight").alias("problem"), "frame", none.cast("long").alias("index"))
        .unionByName(idle.select(F.lit("idle-source").alias("problem"), "frame", none.cast("long").alias("index")))
        .unionByName(empty.select(F.lit("cell-without-source").alias("problem"), none.cast(kind).alias("frame"), F.col("index").cast("long").alias("index")))
    )
