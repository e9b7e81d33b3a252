"""Sources in frames (frame, y, x, value): a meshed background, and the connected regions of pixels that stand over it.

The background is estimated in boxes: values are clipped until they are within CLIP deviations of their mean, and the mode
is taken from mean and median. The mesh of boxes is smoothed by the median of three by three and interpolated to pixels. A
source is a region of touching pixels (corners count) over the level, of a least area. Regions are labelled in strips of
rows, each in a task of its own; regions of two strips that touch at the seam are then joined, so the work of joining grows
with the seams and not with the pixels.

Null and NaN pixels are masked: they have no background and belong to no source. Sources that touch are one region.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.graph import components
from starloom.operators.raster import seen
from starloom.sources.storage import written

BOX, CLIP, CLIPS = 64, 3.0, 4
SIGMAS, LEAST_AREA = 5.0, 5
STRIP = 64
#: Where mean and median lie within 0.3 deviations the mode is 2.5 median - 1.5 mean, else the median; a region
#: thinner than a pixel (determinant of its moments under 0.00694) gets a pixel's own variance, 1/12.
SKEW, MODE, THIN, PIXEL_VARIANCE = 0.3, (2.5, -1.5), 0.00694, 1 / 12
_ROW = 1 << 31  # labels are y * _ROW + x of a region's first pixel in reading order


def _moments(values: Column) -> list[Column]:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / n
    return [mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))]


def _state(values: Column) -> Column:
    mean, sigma = _moments(values)
    return F.struct(values.alias("values"), mean.alias("mean"), sigma.alias("sigma"))


def box_statistics(pixels: DataFrame, box: int = BOX) -> DataFrame:
    """(frame, by, bx, level, sigma): mode and deviation of each box's clipped values. A box has box * box values at most."""
    boxes = pixels.where(seen()).groupBy("frame", F.floor(F.col("y") / box).alias("by"), F.floor(F.col("x") / box).alias("bx")).agg(F.sort_array(F.collect_list("value")).alias("values"))

    def clip(at: Column, _: Column) -> Column:
        return _state(F.filter(at["values"], lambda v: F.abs(v - at["mean"]) <= CLIP * at["sigma"]))

    first = boxes.withColumn("s", _state(F.col("values")))
    last = first.select("frame", "by", "bx", F.aggregate(F.sequence(F.lit(1), F.lit(CLIPS)), F.col("s"), clip).alias("s"))
    n = F.size("s.values")
    median = (F.get("s.values", F.floor((n - 1) / 2).cast("int")) + F.get("s.values", F.floor(n / 2).cast("int"))) / 2
    rows = last.select("frame", "by", "bx", "s.mean", "s.sigma", median.alias("median"))
    mode = F.when(F.abs(F.col("mean") - F.col("median")) <= SKEW * F.col("sigma"), MODE[0] * F.col("median") + MODE[1] * F.col("mean")).otherwise(F.col("median"))
    return rows.select("frame", "by", "bx", mode.alias("level"), "sigma")


def _around(mesh: DataFrame, *values: str) -> DataFrame:
    """Each box of a mesh with itself and its eight neighbours, as rows (frame, by, bx, dy, dx, values)."""
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    told = mesh.select("frame", "by", "bx", *values, steps.alias("d"))
    told = told.select("frame", (F.col("by") - F.col("d.dy")).alias("by"), (F.col("bx") - F.col("d.dx")).alias("bx"), "d.dy", "d.dx", *values)
    return told.join(mesh.select("frame", "by", "bx"), ["frame", "by", "bx"], "left_semi")


def smoothed(mesh: DataFrame) -> DataFrame:
    """The mesh's medians of three by three boxes, as far as there are such."""
    return _around(mesh, "level", "sigma").groupBy("frame", "by", "bx").agg(F.median("level").alias("level"), F.median("sigma").alias("sigma"))


def without_background(pixels: DataFrame, mesh: DataFrame, box: int = BOX) -> DataFrame:
    """Pixels with the mesh, interpolated between the centres of boxes, taken off; at the edges the outer boxes go on.

    A pixel meets one row, that of its box, which holds the neighbours too.
    """
    at = {(dy, dx): F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("level"))).alias(f"n{dy + 1}{dx + 1}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    near = _around(mesh, "level").groupBy("frame", "by", "bx").agg(*at.values())
    near = near.select("frame", "by", "bx", *(F.coalesce(c, "n11").alias(c) for c in (f"n{i}{j}" for i in range(3) for j in range(3))))
    rows = pixels.where(seen()).withColumns({"by": F.floor(F.col("y") / box), "bx": F.floor(F.col("x") / box)}).join(near, ["frame", "by", "bx"])
    rows = rows.withColumns({"v": (F.col("y") + 0.5) / box - 0.5 - F.col("by"), "u": (F.col("x") + 0.5) / box - 0.5 - F.col("bx")})

    def along(offset: Column, low: Column, middle: Column, high: Column) -> Column:
        return F.when(offset < 0, middle + (middle - low) * offset).otherwise(middle + (high - middle) * offset)

    levels = [along(F.col("u"), *(F.col(f"n{i}{j}") for j in range(3))) for i in range(3)]
    return rows.select("frame", "y", "x", (F.col("value") - along(F.col("v"), *levels)).alias("value"))


def _strip_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first pixel, in reading order, of each pixel's region: labels passed between touching pixels, and jumped."""
    code = y * _ROW + x
    order = np.argsort(code)
    code = code[order]
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        to = code + dy * _ROW + dx
        at = np.minimum(np.searchsorted(code, to), len(code) - 1)
        a = np.flatnonzero((code[at] == to) & ((code % _ROW > 0) | (dx >= 0)))
        links.append((a, at[a]))
    a, b = (np.concatenate(v) for v in zip(*links, strict=True))
    label = np.arange(len(code))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(code), np.int64)
    out[order] = code[label]
    return out


def labelled(bright: DataFrame, strip: int = STRIP) -> DataFrame:
    """Pixels (frame, y, x, ...) with label: the number of their region, which is the same for all pixels that touch."""
    kind = bright.schema["frame"].dataType.simpleString()
    others = [c for c in bright.columns if c not in ("frame", "y", "x")]
    rows = bright.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *others).withColumn("strip", F.floor(F.col("y") / strip))

    def label(t: pa.Table) -> pa.Table:
        labels = _strip_labels(t.column("y").to_numpy(), t.column("x").to_numpy())
        return t.select(["frame", "y", "x", *others]).append_column("label", pa.array(labels))

    fields = ", ".join([f"frame {kind}, y long, x long", *(f"{f.name} {f.dataType.simpleString()}" for f in bright.schema if f.name in others), "label long"])
    local = written(rows.groupBy("frame", "strip").applyInArrow(label, fields), "strips")
    # seams: the last row of a strip against the first of the next
    above = local.where(F.col("y") % strip == strip - 1).select("frame", (F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"), F.col("label").alias("a"))
    below = local.where(F.col("y") % strip == 0).select("frame", "y", "x", F.col("label").alias("b"))
    joined = components(above.join(below, ["frame", "y", "x"]).select("frame", "a", "b").distinct(), "frame").withColumnRenamed("node", "label")
    return local.join(joined, ["frame", "label"], "left").select("frame", "y", "x", *others, F.coalesce("root", "label").alias("label"))


def measured_regions(pixels: DataFrame, least_area: int = LEAST_AREA) -> DataFrame:
    """Labelled pixels (frame, y, x, value, noise, label) to regions: first pixel, area, flux, peak, centre and axes a, b."""
    dy, dx, v = F.col("y") - F.floor(F.col("label") / _ROW), F.col("x") - F.col("label") % _ROW, F.col("value")
    sums = pixels.groupBy("frame", "label", "noise").agg(
        F.count(F.lit(1)).alias("area"), F.sum(v).alias("flux"), F.max(v).alias("peak"), F.sum(v * dx).alias("mx"), F.sum(v * dy).alias("my"), F.sum(v * dx * dx).alias("xx"), F.sum(v * dy * dy).alias("yy"), F.sum(v * dx * dy).alias("xy")
    ).where(F.col("area") >= least_area)
    c = F.col
    rows = sums.withColumns({n: c(n) / c("flux") for n in ("mx", "my", "xx", "yy", "xy")})
    rows = rows.withColumns({"vx": c("xx") - c("mx") * c("mx"), "vy": c("yy") - c("my") * c("my"), "vxy": c("xy") - c("mx") * c("my")})
    thin = F.when(c("vx") * c("vy") - c("vxy") * c("vxy") < THIN, PIXEL_VARIANCE).otherwise(0.0)
    rows = rows.withColumn("thin", thin).withColumns({"vx": c("vx") + c("thin"), "vy": c("vy") + c("thin")})
    half, root = (c("vx") + c("vy")) / 2, F.sqrt(F.pow((c("vx") - c("vy")) / 2, 2) + c("vxy") * c("vxy"))
    axis = lambda s: F.sqrt(F.greatest(half + s * root, F.lit(0.0)))
    y, x = F.floor(c("label") / _ROW), c("label") % _ROW
    return rows.select("frame", y.alias("y"), x.alias("x"), "noise", "area", "flux", "peak", (y + c("my")).alias("cy"), (x + c("mx")).alias("cx"), axis(1).alias("a"), axis(-1).alias("b"))


def detected(pixels: DataFrame, box: int = BOX, sigmas: float = SIGMAS, least_area: int = LEAST_AREA, strip: int = STRIP) -> DataFrame:
    """Sources of each frame: regions of at least least_area touching pixels over the background by sigmas times the noise,
    which is the median deviation of the frame's boxes. A frame without noise has none."""
    mesh = written(smoothed(box_statistics(pixels, box)), "mesh")
    noise = mesh.groupBy("frame").agg(F.median("sigma").alias("noise")).where("noise > 0")
    off = without_background(pixels, mesh, box).join(noise, "frame")
    return measured_regions(labelled(off.where(F.col("value") > sigmas * F.col("noise")), strip), least_area)


def frame_quality(sources: DataFrame, scale: float, least: int = 5) -> DataFrame:
    """Medians over a frame's sources: full width at half maximum, eccentricity, signal to noise; frames with fewer than least have none."""
    a, b = F.col("a"), F.col("b")
    rows = sources.where((a > 0) & (b > 0) & (F.col("flux") > 0))
    snr = F.col("flux") / (F.col("noise") * F.sqrt(F.greatest(F.lit(1.0), math.pi * a * b)))
    shape = rows.select("frame", (F.sqrt(a * b) * 2.354820045).alias("fwhm"), F.sqrt(F.least(F.greatest(1 - b * b / (a * a), F.lit(0.0)), F.lit(1.0))).alias("ecc"), snr.alias("snr"))
    out = shape.groupBy("frame").agg((F.median("fwhm") * scale).alias("fwhm_arcsec"), F.median("ecc").alias("eccentricity"), F.greatest(F.lit(0.0), F.median("snr")).alias("signal_to_noise"), F.count(F.lit(1)).alias("stars"))
    return out.where(F.col("stars") >= least).withColumn("tracking_error", F.col("eccentricity") >= 0.8)
