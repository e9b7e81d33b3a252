"""HEALPix indices in the nested scheme, as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 12
#: Fixed values of the scheme: ring and longitude offsets of the twelve base cells.
RING_OF_FACE = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
LONGITUDE_OF_FACE = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def n_cells(order: int) -> int:
    return 12 * 4**order


def parent(index: Column, levels: int = 1) -> Column:
    return F.shiftright(index, 2 * levels)


def children(index: Column) -> Column:
    return F.sequence(index * 4, index * 4 + 3)


def valid(order: Column, index: Column) -> Column:
    return (order >= 0) & (index >= 0) & (index < F.lit(12) * F.pow(F.lit(4), order))


def with_cell(df: DataFrame, ra: str, dec: str, order: int, name: str) -> DataFrame:
    """df with the index at an order of each position (degrees). Steps are separate projections, so that nothing is computed twice."""
    ns = 1 << order
    tmp = {k: f"_{name}_{k}" for k in ("z", "t", "face", "ix", "iy")}
    c = {k: F.col(v) for k, v in tmp.items()}
    df = df.withColumns({tmp["z"]: F.sin(F.radians(dec)), tmp["t"]: F.pmod(F.radians(ra), F.lit(2 * math.pi)) / (math.pi / 2)})
    z, t = c["z"], c["t"]
    belt = F.abs(z) <= 2 / 3
    up, down = F.floor(ns * (0.5 + t) - ns * z * 0.75), F.floor(ns * (0.5 + t) + ns * z * 0.75)
    quarter = F.least(F.lit(3), F.floor(t))
    reach = ns * F.sqrt(3 * (1 - F.abs(z)))
    p = F.least(F.lit(ns - 1), F.floor((t - quarter) * reach))
    m = F.least(F.lit(ns - 1), F.floor((1 - (t - quarter)) * reach))
    fp, fm = F.shiftright(up, order), F.shiftright(down, order)
    mask = ns - 1
    face = F.when(belt, F.when(fp == fm, fp.bitwiseOR(F.lit(4))).when(fp < fm, fp).otherwise(fm + 8)).otherwise(F.when(z >= 0, quarter).otherwise(quarter + 8))
    ix = F.when(belt, down.bitwiseAND(F.lit(mask))).otherwise(F.when(z >= 0, ns - m - 1).otherwise(p))
    iy = F.when(belt, ns - up.bitwiseAND(F.lit(mask)) - 1).otherwise(F.when(z >= 0, ns - p - 1).otherwise(m))
    df = df.withColumns({tmp["face"]: face.cast("bigint"), tmp["ix"]: ix.cast("bigint"), tmp["iy"]: iy.cast("bigint")})
    index = c["face"] * (ns * ns)
    for b in range(order):
        index = index + F.shiftleft(F.shiftright(c["ix"], b).bitwiseAND(F.lit(1)), 2 * b) + F.shiftleft(F.shiftright(c["iy"], b).bitwiseAND(F.lit(1)), 2 * b + 1)
    return df.withColumn(name, index).drop(*tmp.values())


def with_centre(df: DataFrame, index: str, order: int) -> DataFrame:
    """df with centre_ra and centre_dec of the cell."""
    ns = 1 << order
    i = F.col(index)
    inside = i.bitwiseAND(F.lit(ns * ns - 1))
    ix = iy = F.lit(0).cast("bigint")
    for b in range(order):
        ix = ix + F.shiftleft(F.shiftright(inside, 2 * b).bitwiseAND(F.lit(1)), b)
        iy = iy + F.shiftleft(F.shiftright(inside, 2 * b + 1).bitwiseAND(F.lit(1)), b)
    df = df.withColumns({"_face": F.shiftright(i, 2 * order).cast("int"), "_ix": ix, "_iy": iy})
    ring = F.element_at(F.array(*map(F.lit, RING_OF_FACE)), F.col("_face") + 1) * ns - F.col("_ix") - F.col("_iy") - 1
    df = df.withColumn("_ring", ring)
    r = F.col("_ring")
    nr = F.when(r < ns, r).when(r > 3 * ns, 4 * ns - r).otherwise(ns)
    df = df.withColumns({"_nr": nr, "_shift": F.when((r < ns) | (r > 3 * ns), 0).otherwise((r - ns).bitwiseAND(F.lit(1)))})
    nr, shift = F.col("_nr"), F.col("_shift")
    z = F.when(r < ns, 1 - nr * nr / (3.0 * ns * ns)).when(r > 3 * ns, nr * nr / (3.0 * ns * ns) - 1).otherwise((2 * ns - r) * 2 / (3.0 * ns))
    jp = F.floor((F.element_at(F.array(*map(F.lit, LONGITUDE_OF_FACE)), F.col("_face") + 1) * nr + F.col("_ix") - F.col("_iy") + 1 + shift) / 2)
    jp = F.when(jp > 4 * ns, jp - 4 * ns).when(jp < 1, jp + 4 * ns).otherwise(jp)
    phi = (jp - (shift + 1) * 0.5) * (math.pi / 2 / nr)
    return df.withColumns({"centre_ra": F.degrees(phi), "centre_dec": F.degrees(F.asin(z))}).drop("_face", "_ix", "_iy", "_ring", "_nr", "_shift")


def ring_at(dec: Column, order: int) -> Column:
    """Number of the ring of cells at a declination (degrees), with fraction: 1 is the northernmost, 4 * 2**order - 1 the last."""
    ns, z = 1 << order, F.sin(F.radians(dec))
    return F.when(z > 2 / 3, ns * F.sqrt(3 * (1 - z))).when(z < -2 / 3, 4 * ns - ns * F.sqrt(3 * (1 + z))).otherwise(2 * ns - 1.5 * ns * z)


def ring_of_cells(ring: Column, order: int) -> dict[str, Column]:
    """Of a ring of cells: around, a quarter of its number of cells; shift, 1 where they begin at right ascension 0, not half a
    cell after it; step, degrees from one to the next; centre_dec."""
    ns = 1 << order
    nr = F.when(ring < ns, ring).when(ring > 3 * ns, 4 * ns - ring).otherwise(ns)
    shift = F.when((ring < ns) | (ring > 3 * ns), 0).otherwise((ring - ns).bitwiseAND(F.lit(1)))
    z = F.when(ring < ns, 1 - nr * nr / (3.0 * ns * ns)).when(ring > 3 * ns, nr * nr / (3.0 * ns * ns) - 1).otherwise((2 * ns - ring) * 2 / (3.0 * ns))
    return {"around": nr, "shift": shift, "step": 90.0 / nr, "centre_dec": F.degrees(F.asin(z))}


def tile_path(slug: str, generation: int, order: Column, index: Column) -> Column:
    """Storage path of a tile; folders hold 10,000 tiles each."""
    return F.format_string("hips/%s/%d/Norder%d/Dir%d/Npix%d.webp", F.lit(slug), F.lit(generation), order.cast("int"), (F.floor(index / 10000) * 10000).cast("bigint"), index)


def parsed_path(path: Column) -> Column:
    """struct(order, index) of a path that ends as a tile's does, if the folder and index agree and order is up to 9; else null."""
    pattern = r"(?:^|/)Norder(\d+)/Dir(\d+)/Npix(\d+)\.webp$"
    order, folder, index = (F.regexp_extract(path, pattern, g).try_cast("bigint") for g in (1, 2, 3))
    ok = (order <= 9) & (index < F.lit(12) * F.pow(F.lit(4), order)) & (folder == F.floor(index / 10000) * 10000)
    return F.when(ok, F.struct(order.alias("order"), index.alias("index")))


def order_for_width(width: Column) -> Column:
    """Grid order for a view this many degrees wide; null where it is too wide."""
    return F.when(width <= 7.5, 9).when(width <= 15, 8).when(width <= 30, 7).when(width <= 60, 6)


def widest_radius(order: int) -> float:
    """The largest distance (degrees) between a cell's centre and its corners at an order."""
    ns = 1 << order
    t = 1 - 1 / ns
    z1, phi1, z2 = 2 / 3, math.pi / (4 * ns), 1 - t * t / 3
    cosine = math.sqrt((1 - z1 * z1) * (1 - z2 * z2)) * math.cos(phi1) + z1 * z2
    return math.degrees(math.acos(cosine))


def _deinterleaved(index: Column, order: int) -> tuple[Column, Column]:
    inside = index.bitwiseAND(F.lit((1 << order) ** 2 - 1))
    ix = iy = F.lit(0).cast("bigint")
    for b in range(order):
        ix = ix + F.shiftleft(F.shiftright(inside, 2 * b).bitwiseAND(F.lit(1)), b)
        iy = iy + F.shiftleft(F.shiftright(inside, 2 * b + 1).bitwiseAND(F.lit(1)), b)
    return ix, iy


def with_corners(df: DataFrame, index: str, order: int) -> DataFrame:
    """df with corners: array of struct(ra, dec), north, west, south and east corner of the cell in turn."""
    ns = float(1 << order)
    ix, iy = _deinterleaved(F.col(index), order)
    df = df.withColumns({"_face": F.shiftright(F.col(index), 2 * order).cast("int"), "_ix": ix, "_iy": iy})
    ring = F.element_at(F.array(*map(F.lit, RING_OF_FACE)), F.col("_face") + 1)
    turn = F.element_at(F.array(*map(F.lit, LONGITUDE_OF_FACE)), F.col("_face") + 1)
    rows = F.array(*(F.struct(((F.col("_ix") + dx) / ns).alias("x"), ((F.col("_iy") + dy) / ns).alias("y")) for dx, dy in ((1, 1), (0, 1), (0, 0), (1, 0))))
    df = df.withColumns({"_ring": ring, "_turn": turn, "_at": rows})

    def corner(at: Column) -> Column:
        r = F.col("_ring") - at["x"] - at["y"]
        nr = F.when(r < 1, r).when(r > 3, 4 - r).otherwise(1.0)
        z = F.when(r < 1, 1 - nr * nr / 3).when(r > 3, nr * nr / 3 - 1).otherwise((2 - r) * 2 / 3)
        t = F.col("_turn") * nr + at["x"] - at["y"]
        t = F.when(t < 0, t + 8).when(t >= 8, t - 8).otherwise(t)
        ra = F.when(nr < 1e-15, 0.0).otherwise(t * 45 / nr)
        return F.struct(ra.alias("ra"), F.degrees(F.asin(z)).alias("dec"))

    return df.withColumn("corners", F.transform("_at", corner)).drop("_face", "_ix", "_iy", "_ring", "_turn", "_at")
