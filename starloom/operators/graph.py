"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.sources.storage import delete_path, scratch


def components(links: DataFrame, within: str) -> DataFrame:
    """(within, a, b) to (within, node, root): the smallest node that links of the same group lead to.

    Every node hears the least label of its neighbours, takes it, and then takes its label's own label (pointer jumping), so
    that a chain of n links needs about log n rounds. A round is written before the next reads it, and what is read no more
    is removed. Nodes without a link have no row.
    """
    spark, root = links.sparkSession, scratch(links.sparkSession, "components")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    turned = links.select(within, F.col("b").alias("a"), F.col("a").alias("b"))
    both = kept(links.select(within, "a", "b").unionByName(turned).where("a != b").distinct(), "links")
    labels = both.groupBy(within, F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = kept(labels.select(within, "node", F.least("node", "m").alias("root")), "0")
    n = 0
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "b", "root": "r"}), [within, "b"]).groupBy(within, F.col("a").alias("node")).agg(F.min("r").alias("heard"))
        new = labels.join(heard, [within, "node"]).select(within, "node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(within, F.col("node").alias("root"), F.col("root").alias("far"))
        new = new.join(jump, [within, "root"], "left").select(within, "node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = kept(new, str(n + 1))
        delete_path(spark, f"{root}/{n}")
        labels, n = new.select(within, "node", "root"), n + 1
        if new.where("root != old").isEmpty():
            return labels
