import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import text
from starloom.operators import archives, raster
from starloom.sources import readers


def fits(image, **cards):
    axes = {"NAXIS": image.ndim} | {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(image.shape))}
    rows = [f"{'SIMPLE':8}= {'T':>20}", f"{'BITPIX':8}= {-32:>20}", *(f"{k:8}= {v:>20}" for k, v in axes.items()), *(f"{k:8}= '{v}'" for k, v in cards.items()), "END"]
    head = "".join(r.ljust(80) for r in rows).encode()
    data = image.astype(">f4").tobytes()
    pad = lambda b: b + b" " * (-len(b) % 2880)
    return pad(head) + pad(data)


def test_fits(spark, tmp_path):
    image = np.arange(20, dtype=np.float32).reshape(4, 5)
    (tmp_path / "a.fits").write_bytes(fits(image, OBJECT="M31"))
    (tmp_path / "cube.fits").write_bytes(fits(np.stack([image, image + 2])))
    (tmp_path / "bad.fits").write_bytes(b"no image")
    rows = readers.read_fits(spark, f"{tmp_path}/*.fits")
    assert rows.count() == 8 and rows.where("header['OBJECT'] = 'M31'").count() == 4
    pixels = readers.fits_pixels(rows)
    sums = {r.frame.rsplit("/", 1)[-1]: r.s for r in pixels.groupBy("frame").agg(F.sum("value").alias("s")).collect()}
    assert sums == {"a.fits": 190.0, "cube.fits": 210.0}
    assert {r.value for r in raster.downsampled(pixels.where("frame like '%/a.fits'"), 5).collect()} == {9.5}


def test_votable_and_spaced_tables(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<VOTABLE><RESOURCE><TABLE><DATA><TABLEDATA><TR><TD>M31</TD><TD>10.68</TD></TR><TR><TD>M42</TD><TD></TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>")
    assert [tuple(r) for r in readers.read_votable(spark, f"{tmp_path}/t.xml", ["name", "ra"]).orderBy("name").collect()] == [("M31", "10.68"), ("M42", None)]
    (tmp_path / "t.txt").write_text("projcell subcell filter\n1 2 g\n3 4\n5 6 r\n")
    assert [r["filter"] for r in readers.read_spaced(spark, f"{tmp_path}/t.txt").orderBy("projcell").collect()] == ["g", "r"]


def test_grid_wraps_and_view_has_distinct_cells(spark):
    grid = archives.target_grid(spark, 359.99, 0.0, 30.0, 10.0, 2400).collect()
    assert {r.n for r in grid} == set(range(1, len(grid) + 1)) and all(0 <= r.ra < 360 for r in grid) and {r.ra > 180 for r in grid} == {True, False}
    assert archives.target_grid(spark, 10.6847, 41.2692, 60.0, 30.0, 2400).count() >= 20
    cells = archives.viewport_cells(spark, 359.0, 0.0, 10.0, 5.0, 8)
    assert cells.count() == cells.distinct().count() > 300


def test_pixels_go_there_and_back(spark):
    wcs = {"ra": 0.05, "dec": -30.0, "x0": 10.0, "y0": 20.0, "sx": -0.001, "sy": 0.001}
    ra, dec = archives.pixel_to_sky(F.lit(400.0), F.lit(300.0), wcs)
    x, y = archives.sky_to_pixel(ra, dec, wcs)
    row = spark.range(1).select(x.alias("x"), y.alias("y"), ra.alias("ra")).first()
    assert row.x == pytest.approx(400) and row.y == pytest.approx(300) and row.ra > 359
    ring = archives.footprint(spark, 100, 80, wcs | {"ra": 359.999}).collect()
    assert len(ring) == 65 and max(abs(a.continuous_ra - b.continuous_ra) for a, b in zip(ring, ring[1:], strict=False)) < 1


def test_aliases_and_properties(spark):
    row = spark.range(1).select(text.aliases(F.lit("NGC 6960/6992")).alias("a"), text.properties(F.lit("# c = 1\na = b = c\nno\n x =y ")).alias("p")).first()
    assert row.a == ["NGC 6960", "NGC 6992"] and row.p == {"a": "b = c", "x": "y"}


def test_interleaved_numbers_only_the_first_rows_of_a_list(spark):
    lists = [spark.range(k, 3000, 3, 4).select(F.concat(F.lit("n"), (F.col("id") % 1000).cast("string")).alias("name"), F.col("id").alias("at")) for k in range(3)]
    got = readers.interleaved(lists, "name", "at", 5)
    assert [tuple(r) for r in got.collect()] == [("n0", 1, 0), ("n1", 1, 1), ("n2", 1, 2), ("n3", 2, 0), ("n4", 2, 1)]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
