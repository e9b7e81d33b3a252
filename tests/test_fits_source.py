"""The FITS source: byte ranges, cubes, filters on cards."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.plans.registry import QUERIES
from starloom.sources import fits, readers
from starloom.sources.readers import BLOCK, fits_bytes


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    images = {f"a{i}": rng.normal(size=(40 + i, 33)).astype(np.float32) for i in range(3)}
    images["cube"] = rng.normal(size=(3, 20, 11)).astype(np.float32)
    images["cube"][1, 4, 5] = np.nan
    for name, image in images.items():
        (tmp_path / f"{name}.fits").write_bytes(fits_bytes(image, {"OBJECT": name, "FILTER": "r" if name != "a1" else "g"}))
    (tmp_path / "notes.txt").write_text("no image here")
    (tmp_path / "short.fits").write_bytes(b"SIMPLE  =")
    (tmp_path / "cut.fits").write_bytes(fits_bytes(images["a0"], {"OBJECT": "cut", "FILTER": "z"})[: BLOCK + 100])  # a header, and too few pixels
    return tmp_path, images


@pytest.mark.parametrize("range_bytes", [1000, 4096, 1 << 20])
def test_images_are_read_by_ranges(spark, folder, range_bytes):
    path, images = folder
    fits.register(spark)
    df = spark.read.format("fits").option("cards", "OBJECT,FILTER").option("rangeBytes", range_bytes).load(str(path)).where(F.col("FILTER").isin("r", "g"))
    if range_bytes == 1000:
        assert df.rdd.getNumPartitions() > 15
    rows = df.collect()
    got = {}
    for r in rows:
        got.setdefault(r.OBJECT, {})[r.y] = r["values"]
    assert set(got) == set(images) and len(rows) == sum(i.shape[-2] for i in images.values())
    for name, image in images.items():
        want = np.nanmean(image, axis=0) if image.ndim == 3 else image
        assert np.allclose(np.array([got[name][y] for y in range(len(want))], np.float32), want, equal_nan=True, atol=1e-6)


def test_filters_on_cards_leave_files_unread(spark, folder):
    """The file that is cut off can only be left out by its header: reading its pixels fails."""
    path, images = folder
    fits.register(spark)
    df = spark.read.format("fits").option("cards", "OBJECT,FILTER").load(str(path))
    assert {(r.OBJECT, r.height, r.width) for r in df.where("FILTER = 'g'").select("OBJECT", "height", "width").distinct().collect()} == {("a1", 41, 33)}
    with pytest.raises(Exception):
        df.where("FILTER = 'z'").collect()


def test_checksums(spark, folder):
    path, _ = folder
    got = {r.path.rpartition("/")[2]: (r.size, r.sha256) for r in fits.checksums(spark, str(path), 100).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in path.iterdir()}


@pytest.mark.parametrize("seed", range(12))
def test_checksum_cards(seed):
    """The sum of all words is all ones, whatever the pixels; a changed byte is noticed."""
    rng = np.random.default_rng(seed)
    image = (rng.normal(size=(rng.integers(1, 30), rng.integers(1, 30))) * 10.0 ** rng.integers(-5, 6)).astype(np.float32)
    body = readers.with_checksums(image, {"OBJECT": f"m{seed}"})
    assert readers.ones_sum(body) == 0xFFFFFFFF and readers.verified(body) and len(body) % BLOCK == 0
    header, pixels = readers.fits_image(body)
    assert np.array_equal(pixels, image) and header["OBJECT"] == f"m{seed}" and header["CHECKSUM"].isalnum() and len(header["CHECKSUM"]) == 16
    at = int(rng.integers(BLOCK, BLOCK + image.nbytes))
    assert not readers.verified(body[:at] + bytes([body[at] ^ 64]) + body[at + 1 :])
    assert body == readers.with_checksums(image.copy(), {"OBJECT": f"m{seed}"})


def test_master_query(spark, sf_dir):
    rows = QUERIES["s18_master_files"](spark, sf_dir).collect()
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()}
    assert {r.name for r in rows} == suppliers
    for r in rows:
        want = readers.with_checksums(np.array([(r.name + i) % 50 for i in range(20)], np.float32).reshape(4, 5), {})
        assert (r.bytes, r.head, r.sha256) == (len(want), "SIMPLE  =", hashlib.sha256(want).hexdigest())
