"""Rasters in long form (frame, y, x, value): calibration, clipping, stacking, coverage, and display values.

NaN and null pixels are masked. Every operator is a grouped aggregate over pixels, so frames are spread over the cluster
and no image is held whole anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.maths import clamp
from starloom.operators.quantiles import exact_quantiles

PIXEL = ["y", "x"]
EPS32 = 1.1920928955078125e-07


def seen(value: str = "value") -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def master_frame(pixels: DataFrame) -> DataFrame:
    """The median over frames of each pixel."""
    return pixels.where(seen()).groupBy(*PIXEL).agg(F.median("value").alias("value"), F.count(F.lit(1)).alias("frames"))


def calibrated(light: DataFrame, bias: DataFrame, dark: DataFrame, flat: DataFrame, dark_scale: float = 1.0, least_flat: float = 0.05) -> DataFrame:
    """(light - bias - dark * scale) / flat, the flat over its own median; masked where the flat is too dim."""
    level = exact_quantiles(flat.withColumn("flat", F.lit(0)), "flat", [0.5]).select(F.col("value").alias("level"))
    rows = light.join(bias.withColumnRenamed("value", "b"), PIXEL, "left").join(dark.withColumnRenamed("value", "d"), PIXEL, "left").join(flat.withColumnRenamed("value", "f"), PIXEL, "left")
    rows = rows.crossJoin(F.broadcast(level))  # one row
    norm = F.col("f") / F.col("level")
    value = F.col("value") - F.coalesce("b", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)) * dark_scale
    return rows.select("frame", *PIXEL, F.when(F.col("f").isNull(), value).when(norm > least_flat, value / norm).alias("value"))


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def sigma_clipped(pixels: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Weighted mean of each pixel over frames, without values off its median by more than sigmas * 1.4826 * MAD.

    A pixel's values, one a frame, are gathered once and clipped in place: one shuffle.
    """
    rows = pixels.where(seen()).groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("value", "weight"))).alias("vs"))
    rows = rows.withColumn("med", _median(F.transform("vs", lambda r: r["value"])))
    rows = rows.withColumn("mad", _median(F.array_sort(F.transform("vs", lambda r: F.abs(r["value"] - F.col("med"))))))
    sigma, tolerance = 1.4826 * F.col("mad"), EPS32 * F.greatest(F.lit(1.0), F.abs("med"))
    rows = rows.withColumn("most", F.when(sigma > tolerance, sigmas * sigma).otherwise(tolerance))
    rows = rows.withColumn("kept", F.filter("vs", lambda r: F.abs(r["value"] - F.col("med")) <= F.col("most")))
    total = lambda f: F.aggregate("kept", F.lit(0.0), lambda a, r: a + f(r))
    return rows.select(*PIXEL, (total(lambda r: r["weight"] * r["value"]) / total(lambda r: r["weight"])).alias("value"), F.size("kept").cast("long").alias("kept"))


def coadded(pixels: DataFrame) -> DataFrame:
    """Weighted mean, total weight and depth of each pixel."""
    good = pixels.where(seen() & (F.col("weight") > 0))
    return good.groupBy(*PIXEL).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("depth"))


def coverage(stack: DataFrame, height: int, width: int) -> DataFrame:
    return stack.agg((F.count(F.lit(1)) / (height * width)).alias("covered"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"))


def display_limits(pixels: DataFrame, low: float = 0.005, high: float = 0.997) -> DataFrame:
    """Exact percentiles of each frame's values, whatever the frames' size."""
    found = exact_quantiles(pixels.where(seen()), "frame", [low, high])
    return found.groupBy("frame").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def stretched(pixels: DataFrame, limits: DataFrame) -> DataFrame:
    """Values between the limits as 0 to 255 by asinh(10 n) / asinh(10)."""
    n = clamp((F.col("value") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)), 0.0, 1.0)
    level = F.floor(F.asinh(10 * n) / math.asinh(10) * 255 + 0.5).cast("int")
    return pixels.where(seen()).join(limits, "frame").select("frame", *PIXEL, level.alias("level"))


def downsampled(pixels: DataFrame, factor: int) -> DataFrame:
    return pixels.where(seen()).groupBy("frame", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def fractions(pixels: DataFrame, saturated: float, black: float) -> DataFrame:
    v = F.col("value")
    return pixels.groupBy("frame").agg(F.avg((v >= saturated).cast("double")).alias("saturated"), F.avg((v <= black).cast("double")).alias("clipped_black"), F.avg(seen().cast("double")).alias("usable"))


def composite(layers: DataFrame) -> DataFrame:
    """Layers (layer, y, x, value, alpha) over each other in order: value = a * v + (1 - a) * below."""
    rows = F.array_sort(F.collect_list(F.struct("layer", "value", "alpha")))
    over = F.aggregate(F.col("rows"), F.lit(0.0), lambda acc, r: r["alpha"] * r["value"] + (1 - r["alpha"]) * acc)
    return layers.groupBy(*PIXEL).agg(rows.alias("rows")).select(*PIXEL, over.alias("value"))
