"""Cells from positions, masks and cones, reprojection and canvases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.geo import separation_deg
from starloom.functions.maths import clamp
from starloom.operators.archives import pixel_to_sky, sky_to_pixel

LEAST_SHARE, ELIGIBLE_SHARE, LEAST_TILE = 0.01, 0.7, 0.005
SIGMAS, LEAST_STARS = 5.0, 5
CONES_AT_ONCE = 10_000


def cone_cells(spark: SparkSession, ra: float, dec: float, radius: float, order: int, most: int = 4096) -> DataFrame:
    """Cells whose centre lies within the radius, and half a cell around it. From the twelve base cells down, only branches that can meet the cone are followed.

    More than most cells is an error.
    """
    cells = spark.range(12).select(F.col("id").alias("index"))
    for o in range(order + 1):
        if o:
            cells = cells.select(F.explode(H.children(F.col("index"))).alias("index"))
        far = separation_deg(F.col("centre_ra"), F.col("centre_dec"), F.lit(ra), F.lit(dec))
        reach = radius + H.widest_radius(o) + (H.widest_radius(order) if o < order else 0.0)
        cells = H.with_centre(cells, "index", o).where(far <= reach).select("index")
    over = cells.agg(F.assert_true(F.count(F.lit(1)) <= most, F.lit(f"more than {most} cells")).alias("ok"))
    over.collect()
    return cells.select(F.lit(order).alias("order"), "index")


def cones_cells(cones: DataFrame, key: str, order: int) -> DataFrame:
    """(key, order, index) of many cones (key, ra, dec, radius in degrees): cells whose centre lies within the radius, and half a
    cell around it. A cone lists the rings of cells between its northern and southern end, and on each ring the cells
    between its western and eastern end, one more on either side; the distance of these decides."""
    ns, c = 1 << order, F.col
    slim = cones.select(key, c("ra").alias("cone_ra"), c("dec").alias("cone_dec"), (c("radius") + H.widest_radius(order)).alias("reach"))
    slim = slim.where(~F.isnan((c("cone_ra") + c("cone_dec")) * 0.0 + c("reach")))
    dealt = slim.repartition(max(1, slim.count() // CONES_AT_ONCE), key, "cone_ra", "cone_dec")
    ends = (H.ring_at(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c("cone_dec") + s * c("reach"))), order) for s in (1, -1))
    first, last = (F.greatest(F.lit(1), F.least(F.lit(4 * ns - 1), F.floor(end) + more)).cast("int") for end, more in zip(ends, (-1, 2), strict=True))
    rows = dealt.withColumns({"sin_e": F.sin(F.radians("cone_dec")), "cos_e": F.cos(F.radians("cone_dec")), "first": first, "last": last})
    rows = rows.withColumn("ring", F.explode(F.sequence("first", "last"))).drop("first", "last")
    rows = rows.withColumns(H.ring_of_cells(c("ring"), order)).withColumns({"sin_d": F.sin(F.radians("centre_dec")), "cos_d": F.cos(F.radians("centre_dec"))})
    # a half width beyond the poles' sides (or of a cone at a pole, which divides by nothing) is the whole ring
    across = c("cos_d") * c("cos_e")
    cosine = F.when(across > 1e-9, (F.cos(F.radians("reach")) - c("sin_d") * c("sin_e")) / across).otherwise(-1.0)
    half = F.degrees(F.acos(clamp(cosine, -1.0, 1.0))) / c("step")
    middle = (c("cone_ra") / c("step")) + (c("shift") + 1) * 0.5
    west, east = F.floor(middle - half) - 1, F.floor(middle + half) + 2
    whole = (c("reach") >= 90) | (cosine <= -1) | (east - west + 1 >= 4 * c("around"))
    rows = rows.withColumns({"west": F.when(whole, F.lit(1)).otherwise(west), "east": F.when(whole, 4 * c("around")).otherwise(east)})
    rows = rows.withColumn("place", F.explode(F.sequence("west", "east"))).drop("west", "east")
    rows = rows.withColumn("centre_ra", F.degrees((F.pmod(c("place") - 1, 4 * c("around")) + 1 - (c("shift") + 1) * 0.5) * (math.pi / 2 / c("around"))))
    far = F.degrees(F.acos(clamp(c("sin_d") * c("sin_e") + c("cos_d") * c("cos_e") * F.cos(F.radians(c("centre_ra") - c("cone_ra"))), -1.0, 1.0)))
    return H.with_cell(rows.where(far <= c("reach")).select(key, "centre_ra", "centre_dec"), "centre_ra", "centre_dec", order, "index").select(key, F.lit(order).alias("order"), "index")


def mask_cells(pixels: DataFrame, wcs: dict[str, float], orders: tuple[int, ...] = (6, 7, 8, 9)) -> DataFrame:
    """(order, index, coverage, eligible): the share of usable pixels (y, x, usable) of each cell that an image covers.

    Pixels are averaged once, in the finest cells; coarser ones are sums over their descendants.
    """
    ra, dec = pixel_to_sky(F.col("x"), F.col("y"), wcs)
    top = max(orders)
    at = H.with_cell(pixels.select(ra.alias("ra"), dec.alias("dec"), F.col("usable").cast("double").alias("u")), "ra", "dec", top, "cell")
    fine = at.groupBy("cell").agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"))
    each = fine.select(F.explode(F.array(*(F.struct(F.lit(o).alias("order"), H.parent(F.col("cell"), top - o).alias("index")) for o in orders))).alias("c"), "u", "n")
    out = each.groupBy("c.order", "c.index").agg((F.sum("u") / F.sum("n")).alias("coverage"))
    return out.where(F.col("coverage") > LEAST_SHARE).withColumn("eligible", F.col("coverage") >= ELIGIBLE_SHARE)


def tile_plan(pixels: DataFrame, wcs: dict[str, float], fine: int = 9, lowest: int = 7) -> DataFrame:
    """Cells to render: the finest with LEAST_TILE usable pixels or more, and all their ancestors."""
    ra, dec = pixel_to_sky(F.col("x"), F.col("y"), wcs)
    at = H.with_cell(pixels.select(ra.alias("ra"), dec.alias("dec"), F.col("usable").cast("double").alias("u")), "ra", "dec", fine, "cell")
    kept = at.groupBy("cell").agg(F.avg("u").alias("share")).where(F.col("share") >= LEAST_TILE)
    up = kept.select("cell", F.explode(F.sequence(F.lit(lowest), F.lit(fine))).alias("order"))
    return up.select("order", F.expr(f"shiftright(cell, 2 * ({fine} - order))").alias("index")).distinct()


def aligned(source: DataFrame, source_wcs: dict[str, float], target_wcs: dict[str, float], width: int, height: int, least: float = 0.99) -> DataFrame:
    """source (y, x, value) on another image's pixels, by bilinear interpolation; pixels whose four neighbours aren't all there are left out.

    Each target pixel asks for four source pixels with their weights; the join and one sum give its value.
    """
    spark = source.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).alias("tx"), F.floor(F.col("id") / width).alias("ty"))
    ra, dec = pixel_to_sky(F.col("tx"), F.col("ty"), target_wcs)
    sx, sy = sky_to_pixel(ra, dec, source_wcs)
    grid = grid.withColumns({"sx": sx, "sy": sy}).withColumns({"bx": F.floor("sx"), "by": F.floor("sy")}).withColumns({"fx": F.col("sx") - F.col("bx"), "fy": F.col("sy") - F.col("by")})
    share = lambda f, one: F.col(f) if one else 1 - F.col(f)
    four = F.explode(F.array(*(F.struct((F.col("bx") + i).alias("x"), (F.col("by") + j).alias("y"), (share("fx", i) * share("fy", j)).alias("w")) for i in (0, 1) for j in (0, 1))))
    asked = grid.select("tx", "ty", four.alias("n")).select("tx", "ty", "n.x", "n.y", "n.w").where("w > 0")
    good = source.where(F.col("value").isNotNull() & ~F.isnan("value"))
    got = asked.join(good, ["x", "y"]).groupBy("ty", "tx").agg(F.sum(F.col("w") * F.col("value")).alias("sum"), F.sum("w").alias("footprint"))
    return got.where(F.col("footprint") > least).select(F.col("ty").alias("y"), F.col("tx").alias("x"), (F.col("sum") / F.col("footprint")).alias("value"))


def canvas_scale(width_arcsec: Column, height_arcsec: Column, native: Column, most_bytes: Column, overhead: int = 65536, margin: int = 8, most_factor: float = 2.5, tries: int = 8) -> Column:
    """struct(scale, width, height, bytes, ok): the native scale if its float image fits the bytes, else the first coarser one that does, up to most_factor.

    Each try grows the scale by the root of the overshoot and one per cent.
    """
    def planned(scale: Column) -> Column:
        w, h = F.ceil(width_arcsec / scale) + 2 * margin, F.ceil(height_arcsec / scale) + 2 * margin
        return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), (w * h * 4 + overhead).alias("bytes"))

    room = (most_bytes - overhead) / 4.0

    def grown(at: Column, _: Column) -> Column:
        factor = F.greatest(F.lit(1.01), F.sqrt(at["width"] * at["height"] / room) * 1.01)
        return F.when(at["bytes"] <= most_bytes, at).otherwise(planned(at["scale"] * factor))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(tries - 1)), planned(native), grown)
    return F.struct(last["scale"].alias("scale"), last["width"].alias("width"), last["height"].alias("height"), last["bytes"].alias("bytes"), ((last["bytes"] <= most_bytes) & (last["scale"] <= native * most_factor)).alias("ok"))


def render_problems(weights: DataFrame, inventory: DataFrame) -> DataFrame:
    """(problem, n): cells whose weights don't sum to 1 or hold one that is not positive, and sources that no cell uses or that aren't in the inventory."""
    sums = weights.groupBy("order", "index").agg(F.sum("weight").alias("s"), F.min("weight").alias("least"))
    bad = sums.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("least") <= 0)).select(F.lit("weights").alias("problem"))
    sides = weights.select("source", F.lit("w").alias("side")).unionByName(inventory.select("source", F.lit("i").alias("side"))).groupBy("source").agg(F.max("side").alias("most"), F.min("side").alias("least"))
    odd = sides.where("least = most").select(F.when(F.col("most") == "i", "unused-source").otherwise("unknown-source").alias("problem"))
    return bad.unionByName(odd).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def detected(pixels: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """Point sources of each frame (frame, y, x, value) by their peaks alone, for frames of even background (operators.extraction has regions): peaks over the background by so many sigmas, with flux and axes a, b from the moments of 5 by 5 pixels.

    The background is the frame's median, its noise 1.4826 times the median deviation. A peak is a bright pixel with no
    brighter neighbour (of equal ones the first in reading order); peaks meet their neighbourhood by a join on pixels.
    """
    level = pixels.groupBy("frame").agg(F.median("value").alias("level"))
    off = pixels.join(level, "frame").withColumn("value", F.col("value") - F.col("level")).drop("level")
    noise = off.groupBy("frame").agg((F.median(F.abs("value")) * 1.4826).alias("noise"))
    bright = off.join(noise, "frame").where((F.col("noise") > 0) & (F.col("value") > sigmas * F.col("noise")))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3))))
    asked = bright.select("frame", F.col("y").alias("py"), F.col("x").alias("px"), F.col("value").alias("peak"), "noise", around.alias("n"))
    asked = asked.select("*", (F.col("py") + F.col("n.dy")).alias("y"), (F.col("px") + F.col("n.dx")).alias("x"))
    met = asked.join(off, ["frame", "y", "x"])
    dx, dy, v = F.col("n.dx"), F.col("n.dy"), F.greatest(F.col("value"), F.lit(0.0))
    close = (F.abs(dx) <= 1) & (F.abs(dy) <= 1)
    earlier = (dy < 0) | ((dy == 0) & (dx < 0))
    beaten = close & ((F.col("value") > F.col("peak")) | ((F.col("value") == F.col("peak")) & earlier))
    sums = met.groupBy("frame", "py", "px", "noise").agg(F.max(beaten).alias("beaten"), F.sum(v).alias("flux"), F.sum(v * dx).alias("mx"), F.sum(v * dy).alias("my"), F.sum(v * dx * dx).alias("xx"), F.sum(v * dy * dy).alias("yy"), F.sum(v * dx * dy).alias("xy"))
    peaks = sums.where(~F.col("beaten")).select("frame", F.col("py").alias("y"), F.col("px").alias("x"), "noise", "flux", *((F.col(n) / F.col("flux")).alias(n) for n in ("mx", "my", "xx", "yy", "xy")))
    c = F.col
    peaks = peaks.withColumns({"vx": c("xx") - c("mx") * c("mx"), "vy": c("yy") - c("my") * c("my"), "vxy": c("xy") - c("mx") * c("my")})
    half, root = (c("vx") + c("vy")) / 2, F.sqrt(F.pow((c("vx") - c("vy")) / 2, 2) + c("vxy") * c("vxy"))
    axis = lambda s: F.sqrt(F.greatest(half + s * root, F.lit(1e-4)))
    return peaks.select("frame", "y", "x", "noise", "flux", axis(1).alias("a"), axis(-1).alias("b"))


def frame_quality(stars: DataFrame, scale: float) -> DataFrame:
    """Medians over a frame's stars: full width at half maximum, eccentricity, signal to noise; frames with fewer than LEAST_STARS have none."""
    a, b = F.col("a"), F.col("b")
    shape = stars.select("frame", (F.sqrt(a * b) * 2.354820045).alias("fwhm"), F.sqrt(F.least(F.greatest(1 - b * b / (a * a), F.lit(0.0)), F.lit(1.0))).alias("ecc"), (F.col("flux") / (F.col("noise") * F.sqrt(F.greatest(F.lit(1.0), math.pi * a * b)))).alias("snr"))
    out = shape.groupBy("frame").agg((F.median("fwhm") * scale).alias("fwhm_arcsec"), F.median("ecc").alias("eccentricity"), F.greatest(F.lit(0.0), F.median("snr")).alias("signal_to_noise"), F.count(F.lit(1)).alias("stars"))
    return out.where(F.col("stars") >= LEAST_STARS).withColumn("tracking_error", F.col("eccentricity") >= 0.8)
