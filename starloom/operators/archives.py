"""Discovery in archives: target grids, records of different providers in one shape, rights, reuse, and image geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.maths import cosd, half_up, rev, sind

#: Size in degrees of a cell in view planning, by order.
CELL_DEG = {6: 0.916, 7: 0.458, 8: 0.229, 9: 0.115}
VIEWS_AT_ONCE = 1024
OPEN_RIGHTS = ("PUBLIC", "OPEN", "CC0", "CC-BY")


def target_grid(spark: SparkSession, ra: float, dec: float, width: float, height: float, pixels: int, overlap: float = 0.15) -> DataFrame:
    """Cutout centres over a field (arcmin), nearest to its centre first."""
    cutout = pixels * 0.25 / 60
    step = cutout * (1 - overlap)
    nx, ny = max(1, math.ceil(width / step)), max(1, math.ceil(height / step))
    x = (F.col("i") - (nx - 1) / 2) * step
    y = (F.col("j") - (ny - 1) / 2) * step
    rows = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j")).withColumns({"x": x, "y": y})
    out = rows.select(rev(ra + F.col("x") / (60 * max(0.1, math.cos(math.radians(dec))))).alias("ra"), (dec + F.col("y") / 60).alias("dec"), (F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("d2"))
    return out.select("ra", "dec", F.row_number().over(W.orderBy("d2", "dec", "ra")).alias("n"))


def viewport_cells(spark: SparkSession, ra: float, dec: float, width: float, height: float, order: int, limit: int = 4000) -> DataFrame:
    """Cells met when a view is walked in steps of 0.8 cells, in the order met."""
    step = CELL_DEG[order] * 0.8
    low, high = max(-90.0, dec - height / 2 - step), min(90.0, dec + height / 2 + step)
    rows = spark.range(int((high - low) / step) + 1).select(F.col("id").alias("row"), (low + F.col("id") * step).alias("dec"))
    rows = rows.withColumn("step", step / F.greatest(F.lit(0.15), cosd(F.col("dec"))))
    n = F.floor((width + 2 * F.col("step")) / F.col("step")).cast("int")
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), n)))
    rows = rows.withColumn("ra", rev(ra - width / 2 - F.col("step") + F.col("col") * F.col("step")))
    cells = H.with_cell(rows, "ra", "dec", order, "index").groupBy("index").agg(F.min(F.struct("row", "col")).alias("met"))
    return cells.orderBy("met.row", "met.col").limit(limit).select(F.lit(order).alias("order"), "index")


def views_cells(views: DataFrame, order: int, limit: int = 4000) -> DataFrame:
    """(view, order, index) of many views (view, ra, dec, width, height in degrees): the cells that each meets when it is walked in
    steps of 0.8 cells, the first limit in the order met."""
    step = CELL_DEG[order] * 0.8
    c = F.col
    # a task walks about VIEWS_AT_ONCE views; what they meet is not shuffled again
    views = views.repartition(max(1, views.count() // VIEWS_AT_ONCE), "view")
    rows = views.select("view", c("ra").alias("mid"), "width", F.greatest(F.lit(-90.0), c("dec") - c("height") / 2 - step).alias("low"), F.least(F.lit(90.0), c("dec") + c("height") / 2 + step).alias("high"))
    rows = rows.select("view", "mid", "width", "low", F.explode(F.sequence(F.lit(0), F.floor((c("high") - c("low")) / step).cast("int"))).alias("row"))
    rows = rows.withColumn("dec", c("low") + c("row") * step).withColumn("step", step / F.greatest(F.lit(0.15), cosd(c("dec"))))
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((c("width") + 2 * c("step")) / c("step")).cast("int"))))
    rows = rows.select("view", "row", "col", "dec", rev(c("mid") - c("width") / 2 - c("step") + c("col") * c("step")).alias("ra"))
    cells = H.with_cell(rows, "ra", "dec", order, "index").groupBy("view", "index").agg(F.min(F.shiftleft(c("row").cast("long"), 32) + c("col")).alias("met"))
    nth = F.row_number().over(W.partitionBy("view").orderBy("met"))
    return cells.withColumn("nth", nth).where(c("nth") <= limit).select("view", F.lit(order).alias("order"), "index")


def may_redistribute(rights: Column, provider_default: Column) -> Column:
    """By the words of the rights statement; without one, the provider's default."""
    r = F.upper(F.trim(rights))
    return F.when(r.isNull() | (r == ""), provider_default).when(r.rlike("COPYRIGHT|ALL RIGHTS RESERVED|PRIVATE|PROPRIETARY"), False).when(r.isin(*OPEN_RIGHTS), True).otherwise(provider_default)


def first_text(record: Column, names: list[str]) -> Column:
    """The first of several fields of a map that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(record[n]), F.lit("")) for n in names))


def normalised(records: DataFrame, aliases: dict[str, list[str]], key: str, order: str) -> DataFrame:
    """Records (a map of lower-case names to texts, and columns to keep) as one row for each key, the first seen."""
    out = records.withColumns({name: first_text(F.col("record"), names) for name, names in aliases.items()}).drop("record").where(F.col(key).isNotNull())
    return out.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def unseen_first(candidates: DataFrame, known: DataFrame, key: str, salt: str, limit: int) -> DataFrame:
    """Candidates that aren't known, spread by a hash of the key, the first few."""
    return candidates.join(known.select(key), key, "left_anti").withColumn("spread", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)).orderBy("spread").limit(limit)


def pixel_to_sky(x: Column, y: Column, wcs: dict[str, float]) -> tuple[Column, Column]:
    """Gnomonic (TAN) projection: pixel to right ascension and declination. wcs: ra, dec, x0, y0, and degrees a pixel sx, sy."""
    u, v = (x - wcs["x0"]) * wcs["sx"], (y - wcs["y0"]) * wcs["sy"]
    u, v = F.radians(u), F.radians(v)
    d0 = math.radians(wcs["dec"])
    down = math.cos(d0) - v * math.sin(d0)
    ra = rev(wcs["ra"] + F.degrees(F.atan2(u, down)))
    dec = F.degrees(F.atan2((math.sin(d0) + v * math.cos(d0)), F.sqrt(u * u + down * down)))
    return ra, dec


def sky_to_pixel(ra: Column, dec: Column, wcs: dict[str, float]) -> tuple[Column, Column]:
    a, d0 = ra - wcs["ra"], math.radians(wcs["dec"])
    deep = sind(dec) * math.sin(d0) + cosd(dec) * math.cos(d0) * cosd(a)
    u = F.degrees(cosd(dec) * sind(a) / deep)
    v = F.degrees((sind(dec) * math.cos(d0) - cosd(dec) * math.sin(d0) * cosd(a)) / deep)
    return u / wcs["sx"] + wcs["x0"], v / wcs["sy"] + wcs["y0"]


def footprint(spark: SparkSession, width: int, height: int, wcs: dict[str, float], samples: int = 16) -> DataFrame:
    """Ring of positions along an image's edges, with right ascension unwrapped along the ring."""
    t = F.col("k") / samples
    edge = F.col("edge")
    x = F.when(edge == 0, t).when(edge == 1, 1.0).when(edge == 2, 1 - t).otherwise(0.0) * (width - 1)
    y = F.when(edge == 0, 0.0).when(edge == 1, t).when(edge == 2, 1.0).otherwise(1 - t) * (height - 1)
    rows = spark.range(4 * samples + 1).select(F.col("id").alias("n"), F.floor(F.col("id") / samples).alias("edge"), (F.col("id") % samples).alias("k")).withColumn("edge", F.col("edge") % 4)
    ra, dec = pixel_to_sky(x, y, wcs)
    ring = rows.select("n", ra.alias("ra"), dec.alias("dec"))
    turn = W.orderBy("n")
    jump = F.col("ra") - F.lag("ra").over(turn)
    wraps = F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0)
    return ring.withColumn("_w", wraps).select("n", half_up(F.col("ra"), 8).alias("ra"), half_up(F.col("dec"), 8).alias("dec"), half_up(F.col("ra") + F.sum("_w").over(turn), 8).alias("continuous_ra"))
