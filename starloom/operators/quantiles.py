"""Exact quantiles of large groups in bounded memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.sources.storage import delete_path, scratch

BUCKETS = 1024


def exact_quantiles(values: DataFrame, key: str, shares: Sequence[float], value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """(key, share, value): quantiles of each group, with linear interpolation between the two values next to them.

    The value of a rank is looked for in a range that starts as all values of the group. The range is cut into buckets,
    which are counted by partial sums, and the bucket that holds the rank is the next range, until it holds one value only.
    All groups and ranks are refined at once; a task holds counts of at most ``buckets`` buckets for each group and rank, never
    a group's values. Values are written once, and read by each round. Null and NaN values are left out.
    """
    spark, root = values.sparkSession, scratch(values.sparkSession, "quantiles")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    slim = kept(values.select(F.col(key).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values")
    groups = slim.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    shares_ = F.explode(F.array(*(F.lit(float(q)) for q in shares))).alias("share")
    wanted = groups.select("*", shares_).withColumn("at", F.col("share") * (F.col("n") - 1)).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.least(F.col("n") - 1, F.floor("at") + F.col("part"))
    ranks = kept(wanted.select("g", "share", "part", (F.col("at") - F.floor("at")).alias("fraction"), rank.cast("long").alias("rank"), "low", "high", F.lit(0).cast("long").alias("below")), "0")
    done, n = [ranks.where("low = high")], 0
    while True:
        open_ = ranks.where("low < high")
        if open_.isEmpty():
            break
        r = open_.select(F.col("g").alias("h"), "share", "part", "low", "high")
        met = slim.join(r, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
        at = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, lest the range overflow
        bucket = F.least(F.lit(buckets - 1), F.floor(at * buckets)).alias("bucket")
        counted = met.groupBy("g", "share", "part", bucket).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(W.partitionBy("g", "share", "part").orderBy("bucket"))
        c, o = counted.withColumn("upto", upto).alias("c"), open_.alias("o")
        same = F.col("c.g").eqNullSafe(F.col("o.g")) & (F.col("c.share") == F.col("o.share")) & (F.col("c.part") == F.col("o.part"))
        left = F.col("o.rank") - F.col("o.below")
        here = c.join(o, same).where((F.col("c.upto") - F.col("c.c") <= left) & (left < F.col("c.upto")))
        n += 1
        ranks = kept(here.select("o.g", "o.share", "o.part", "o.fraction", "o.rank", F.col("c.least").alias("low"), F.col("c.most").alias("high"), (F.col("o.below") + F.col("c.upto") - F.col("c.c")).alias("below")), str(n))
        done.append(ranks.where("low = high"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    weight = F.when(F.col("part") == 0, 1 - F.col("fraction")).otherwise(F.col("fraction"))
    # a part of no weight is left out, lest an infinite value next to the quantile spoil it
    out = kept(found.groupBy("g", "share").agg(F.sum(F.when(weight > 0, weight * F.col("low"))).alias("value")), "found")
    delete_path(spark, f"{root}/values")
    return out.select(F.col("g").alias(key), "share", "value")
