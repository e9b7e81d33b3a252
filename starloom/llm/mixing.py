"""Mixing sources to target weights by hash-threshold histograms.

Every document draws a 60-bit hash of its id and text. A source that needs a fraction of its words takes the documents
whose hash lies under a threshold, and the threshold is found without sorting: words are summed by source and hash bucket,
the bucket that holds the budget is the boundary, and only this one is split further, level by level, until it holds a
single hash. All sources are refined at once; what is gathered is a histogram of at most ``2**BITS`` buckets a source.
Rows alike in id and text share their hash. Where such rows are the boundary, they are told apart by a second draw from
all their columns, by the same histograms, and only rows alike in every column by their place in the written table; reruns
agree whichever of these are taken.

Documents of null or empty text have size 0 and are taken 0 words. A null source is a source of its own, last in order. A
null id is an id like any other. Reruns agree, whatever the partitioning. Extra columns are carried along; the operator's
result columns replace input columns of the same name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, shielding, text_of, word_count, written

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 12, 5
ALIKE_BITS = 20
ADDED = {"size", "source_size", "target", "copies", "taken"}


def draw(key: Column, text: Column) -> Column:
    """60 bits of md5, as long; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 15), 16, 10).cast("long")


def with_running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """rows with row_number and, for each of sums, its total over the rows before, by an order over the whole table.

    The table is cut into ranges of the order; each range is numbered by itself and starts from the totals of the ranges
    before it, of which there are no more than shuffle partitions. No task sees the whole table.
    """
    ranges = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    own = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = {"row_number": F.lit(1), **sums}
    part = ranges.withColumns({f"__v_{n}": c for n, c in sums.items()}).withColumns({f"__in_{n}": F.coalesce(F.sum(f"__v_{n}").over(own), F.lit(0)) for n in sums})
    part = scratch.write(part, "ranges")
    totals = part.groupBy("__range").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__range", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums))
    out = part.join(starts, "__range").withColumns({n: F.col(f"__in_{n}") + F.col(f"__b_{n}") for n in sums})
    return out.withColumn("row_number", F.col("row_number") + 1).select(*rows.columns, *sums)


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating. Targets share the sum of all
    sizes by weight, no target over cap times its source's size; what is over goes to the others by weight. That is
    target = min(cap * size, level * weight), with one level for all: sources ordered by cap * size / weight reach their
    cap one after the other, and the level follows from the sums up to there.
    """
    table = F.array(*map(F.lit, map(float, weights)))
    ranked = with_running(sizes, [F.col("source").asc_nulls_last()], {}, scratch)
    ranked = ranked.select("source", "source_size", F.element_at(table, ((F.col("row_number") - 1) % len(weights) + 1).cast("int")).alias("w"))
    ranked = scratch.write(ranked.withColumn("cap", F.col("source_size") * float(cap)), "weights")
    all_ = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    upto = with_running(ranked, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "w_before": F.col("w")}, scratch)
    levels = upto.withColumn("level", (F.lit(float(all_.size)) - F.col("cap_before")) / (F.lit(all_.w) - F.col("w_before")))
    # the first source in this order that does not reach its cap fixes the level of all behind it
    level = levels.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("row_number", "level")).alias("first")).first().first
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level.level) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, scratch: Scratch, draw_: str = "hash") -> DataFrame:
    """docs (source, size, draw) and budgets (source, budget) to (source, at, left, words, rows): the boundary of each source.

    Documents that drew less than ``at`` hold budget - left words, and those that drew it (rows of them) hold more than
    left. A source whose budget is not under its size has no row.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        own = F.col("d.source").eqNullSafe(F.col("s.source"))
        inside = docs.alias("d").join(state.alias("s"), own & (F.shiftright(f"d.{draw_}", shift + BITS) == F.col("s.prefix")) if level else own)
        histogram = inside.groupBy("d.source", F.shiftright(f"d.{draw_}", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = W.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.sum("words").over(upto)).alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        boundary = running.where(F.col("h.upto") > F.col("s.left")).groupBy("h.source").agg(F.min(F.struct("h.bucket", "h.upto", "h.words", "h.rows", "s.left")).alias("b"))
        state = boundary.select("source", (F.col("b.left") - (F.col("b.upto") - F.col("b.words"))).alias("left"), F.col("b.bucket").alias("prefix"), F.col("b.words").alias("words"), F.col("b.rows").alias("rows"))
        state = scratch.write(state, "boundary")
    return state.select("source", F.col("prefix").alias("at"), "left", "words", "rows")


def _nearer() -> Column:
    """The threshold on the side of the boundary that comes nearer to the budget."""
    return F.when(F.col("left") * 2 >= F.col("words"), F.col("at") + 1).otherwise(F.col("at"))


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with size and what they draw, written once: mix_sized() reads no text."""
    docs = docs.drop(*(ADDED - {text, source, key}))
    # of rows that share a draw the whole row decides, and only between rows alike in every column their place
    row = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    low = F.lit((1 << ALIKE_BITS) - 1)
    place = F.shiftright(row, 4).bitwiseAND(F.lit((1 << 60) - 1).bitwiseAND(F.bitwise_not(low))).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low))
    return docs.withColumns({"size": word_count(F.col(text)), "__mix_hash": draw(F.col(key), text_of(text)), "__mix_place": place})


def mix_sized(table: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """A written table of sized() with source_size, target, copies and taken: the words the mix takes of a document, repeats counted.

    A source takes floor(target / size) copies of all its documents, and one more of those under its hash threshold.
    """
    scratch = Scratch(table.sparkSession, "mixing")
    slim = table.select(F.col(source).alias("source"), "size", F.col("__mix_hash").alias("hash"), F.col("__mix_place").alias("place"))
    targets = scratch.write(source_targets(scratch.write(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes"), scratch, weights, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = thresholds(slim, budgets.where(F.col("source_size") > 0), scratch)
    alike = edge.where("rows > 1").select("source", F.col("at").alias("hash"), F.col("left").alias("budget"))
    places = edge.limit(0).select("source", F.col("at").alias("place_under"))
    if not alike.isEmpty():
        same = slim.alias("d").join(alike.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.hash") == F.col("s.hash"))).select("d.source", "size", "place")
        places = thresholds(same, alike, scratch, "place").select("source", _nearer().alias("place_under"))
    plan = budgets.alias("b").join(edge.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left").join(places.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")), "left")
    under = F.when(F.col("place_under").isNull(), _nearer()).otherwise(F.col("at"))
    plan = scratch.write(plan.select(F.col("b.source").alias("__mix_plan"), "source_size", "target", F.col("whole").alias("__mix_whole"), under.alias("__mix_under"), F.col("at").alias("__mix_at"), F.col("place_under").alias("__mix_place_under")), "plan")
    scratch.keep_only(plan)
    out = table.join(plan, F.col(source).eqNullSafe(F.col("__mix_plan")), "left")
    more = (F.col("__mix_hash") < F.col("__mix_under")) | (F.col("__mix_hash") == F.col("__mix_at")) & (F.col("__mix_place") < F.col("__mix_place_under"))
    copies = F.col("__mix_whole") + F.when(more, 1).otherwise(0)
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("__mix_hash", "__mix_place", *(c for c in plan.columns if c.startswith("__mix")))


@shielding("__mix_hash", "__mix_place", "__mix_plan", "__mix_whole", "__mix_under", "__mix_at", "__mix_place_under")
def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target, copies and taken."""
    return mix_sized(written(sized(docs, text, source, key), "mixing-sized"), source, weights, cap)
