"""A coadd that grows: frames are added in any order and in any number of batches, each of them once.

The state is one published table: for each pixel the sum of weight times value, the sum of weights and the number of frames,
which add up whatever the order; and a row for each frame that has entered. A batch leaves out frames that are in the state
already, sums up the others by pixel before they meet it, and publishes pixels and frames together as the next version. So a
batch that is sent again changes nothing, a reader never sees half of one, and of two batches at once the second to publish
starts again from the version of the first.

Masked pixels (null, NaN) and weights that aren't positive and finite add nothing; their frame has entered nevertheless. A
frame must come whole in one batch; rows of it that repeat count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.raster import seen
from starloom.sources.publication import Published, Superseded, Version
from starloom.sources.storage import written

STATE = "frame string, y long, x long, numerator double, denominator double, hits long"
TRIES = 20


def added(place: Published, pixels: DataFrame) -> Version:
    """Adds a batch of frames (frame, y, x, value, weight); the version that holds them."""
    schema = place.spark.createDataFrame([], STATE).schema
    batch = pixels.select(F.col("frame").cast("string").alias("frame"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value", "weight")
    batch = written(batch.dropDuplicates(["frame", "y", "x"]), "coadd-batch")
    for _ in range(TRIES):
        version = place.version()
        state = place.read(schema, version.number)
        known = state.where("frame IS NOT NULL").select("frame")
        new = batch.join(known, "frame", "left_anti")
        good = new.where(seen() & (F.col("weight") > 0) & (F.col("weight") < float("inf")))
        sums = good.groupBy("y", "x").agg(F.sum(F.col("weight") * F.col("value")).alias("numerator"), F.sum("weight").alias("denominator"), F.count(F.lit(1)).alias("hits"))
        both = state.where("frame IS NULL").select("y", "x", "numerator", "denominator", "hits").unionByName(sums)
        merged = both.groupBy("y", "x").agg(*(F.sum(c).alias(c) for c in ("numerator", "denominator", "hits")))
        entered = known.unionByName(new.select("frame").distinct())
        rows = merged.select(F.lit(None).cast("string").alias("frame"), "y", "x", "numerator", "denominator", "hits").unionByName(entered, allowMissingColumns=True)
        try:
            staged = place.stage(rows.select(schema.names))
            return place.switch(Version(version.number, staged.folder, staged.rows, staged.digest))
        except Superseded:
            continue
    raise Superseded(f"gave up after {TRIES} tries")


def result(place: Published) -> DataFrame:
    """(y, x, value, weight, depth) of all frames so far."""
    state = place.read(place.spark.createDataFrame([], STATE).schema).where("frame IS NULL AND denominator > 0")
    return state.select("y", "x", (F.col("numerator") / F.col("denominator")).alias("value"), F.col("denominator").alias("weight"), F.col("hits").alias("depth"))


def missing(place: Published, inventory: DataFrame) -> DataFrame:
    """Frames of an inventory (frame) that have not entered."""
    state = place.read(place.spark.createDataFrame([], STATE).schema).where("frame IS NOT NULL").select("frame")
    return inventory.select(F.col("frame").cast("string").alias("frame")).join(state, "frame", "left_anti")
