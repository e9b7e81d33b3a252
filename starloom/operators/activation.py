"""From a staged generation to the current one: integrity rules as rows that break them, the switch itself, and changes as new table versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import healpix as H

SHA256 = "^[0-9a-f]{64}$"
CELL = ["order", "index"]


def plan_sha256(plan: DataFrame) -> DataFrame:
    """(generation, sha256) over each plan's cells as JSON rows, by order and index. A plan is one generation's cells, thousands at most."""
    rows = F.array_sort(F.collect_list(F.struct("order", "index")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.lit('{"index": '), r["index"].cast("string"), F.lit(', "order": '), r["order"].cast("string"), F.lit("}"))), ", ")
    return plan.groupBy("generation").agg(F.sha2(F.concat(F.lit("["), text, F.lit("]")), 256).alias("sha256"))


def inventory_sha256(inventory: DataFrame) -> DataFrame:
    """(generation, sources, sha256, hours) over the sorted source ids, each with a line end."""
    ids = F.array_sort(F.collect_list(F.col("source").cast("string")))
    return inventory.groupBy("generation").agg(F.count(F.lit(1)).alias("sources"), F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("sha256"), (F.sum("exposure_s") / 3600).alias("hours"))


def _problem(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("generation", F.lit(name).alias("problem"))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def activation_problems(generations: DataFrame, plan: DataFrame, tiles: DataFrame, inventory: DataFrame, stored: DataFrame, masters: DataFrame) -> DataFrame:
    """(generation, problem, n): every rule that a staged generation breaks, and how often; none may be left before activation.

    generations: generation, object_id, version, status, locked, manifest_path, manifest_sha256, failed_tiles, validated,
    plan_sha256, planned_tiles, expected_tiles, published_tiles, expected_sources, contributing_sources, inventory_sha256.
    plan: generation, order, index. tiles: generation, order, index, sha256, path, sources (array), weights (map).
    inventory: generation, source, exposure_s, eligible_cells, solution_version. stored: path. masters: generation, object_id,
    is_current, lights, hours, fits_path, fits_sha256, preview_path, preview_sha256, covered, partial, scale, width, height.

    Tables that several rules need are aggregated once for each generation and joined to it; nothing is collected.
    """
    c = F.col
    counts = plan.groupBy("generation").agg(F.count(F.lit(1)).alias("plan_rows"), F.count_distinct(*CELL).alias("plan_cells"), F.min("order").alias("low"), F.max("order").alias("high"))
    actual = tiles.groupBy("generation").agg(F.count(F.lit(1)).alias("tile_rows"), F.count_distinct(*CELL).alias("tile_cells"))
    used = tiles.select("generation", F.explode("sources").alias("source"), "weights")
    union = used.groupBy("generation").agg(F.count_distinct("source").alias("union_sources"))
    frozen = inventory_sha256(inventory).withColumnRenamed("sha256", "frozen_sha256")
    g = generations.join(counts, "generation", "left").join(plan_sha256(plan).withColumnRenamed("sha256", "computed_sha256"), "generation", "left").join(actual, "generation", "left").join(union, "generation", "left").join(frozen, "generation", "left")
    ready = (c("status") == "verifying") & c("locked") & c("manifest_path").isNotNull() & c("manifest_sha256").rlike(SHA256) & (c("failed_tiles") == 0) & c("validated")
    no = lambda n: F.coalesce(c(n), F.lit(0))

    deep = plan.join(counts.select("generation", "low", "high"), "generation")
    parents = plan.select("generation", (c("order") + 1).alias("order"), F.explode(H.children(c("index"))).alias("index"))
    children = plan.select("generation", (c("order") - 1).alias("order"), H.parent(c("index")).alias("index")).distinct()
    cells = plan.select("generation", *CELL).distinct().withColumn("side", F.lit("p")).unionByName(tiles.select("generation", *CELL).distinct().withColumn("side", F.lit("t")))
    sides = cells.groupBy("generation", *CELL).agg(F.max("side").alias("most"), F.min("side").alias("least"))
    sources = inventory.select("generation", "source", F.lit("e").alias("side")).unionByName(used.select("generation", "source", F.lit("u").alias("side")).distinct())
    both = sources.groupBy("generation", "source").agg(F.max("side").alias("most"), F.min("side").alias("least"))
    have = stored.select(c("path").alias("stored_path")).distinct()
    missing = lambda rows, path: rows.join(have, rows[path] == have["stored_path"], "left_anti")
    m = masters.join(generations.select("generation", "expected_sources", c("object_id").alias("run_object")), "generation").join(frozen.select("generation", c("hours").alias("frozen_hours")), "generation", "left")
    fine_master = ~c("is_current") & (c("lights") == c("expected_sources")) & (F.abs(c("hours") - c("frozen_hours")) <= 1e-6) & c("fits_path").isNotNull() & c("fits_sha256").rlike(SHA256) & c("preview_path").isNotNull() & c("preview_sha256").rlike(SHA256) & c("covered").isNotNull() & ((c("covered") >= 1) | c("partial")) & c("scale").isNotNull() & c("width").isNotNull() & c("height").isNotNull()

    rules = [
        _problem(g.where(~F.coalesce(ready, F.lit(False))), "not-ready"),
        _problem(g.where(_differs(c("plan_sha256"), c("computed_sha256"))), "plan-hash"),
        _problem(g.where((no("plan_rows") == 0) | (c("plan_rows") != c("plan_cells")) | _differs(c("plan_rows"), c("planned_tiles")) | _differs(c("planned_tiles"), c("expected_tiles")) | _differs(c("expected_tiles"), c("published_tiles"))), "planned-counts"),
        _problem(deep.where(c("order") > c("low")).join(parents, ["generation", *CELL], "left_anti"), "no-parent"),
        _problem(deep.where(c("order") < c("high")).join(children, ["generation", *CELL], "left_anti"), "no-child"),
        _problem(g.where(_differs(c("sources"), c("expected_sources")) | _differs(c("frozen_sha256"), c("inventory_sha256"))), "inventory"),
        _problem(inventory.where(no("eligible_cells") == 0), "source-without-cell"),
        _problem(inventory.where("eligible_cells > 0").join(generations.select("generation", "version"), "generation").where(_differs(c("solution_version"), c("version"))), "solution-version"),
        _problem(g.where((no("tile_rows") != c("expected_tiles")) | (no("tile_cells") != c("expected_tiles"))), "tile-counts"),
        _problem(sides.where("least = most and most = 'p'"), "tile-missing"),
        _problem(sides.where("least = most and most = 't'"), "tile-unexpected"),
        _problem(tiles.where(~F.coalesce(c("sha256").rlike(SHA256), F.lit(False)) | (F.coalesce(F.size("sources"), F.lit(0)) <= 0) | c("weights").isNull()), "tile-artefact"),
        _problem(missing(tiles, "path"), "tile-not-stored"),
        _problem(used.where(~F.coalesce(F.map_contains_key("weights", c("source")), F.lit(False))), "no-weight"),
        _problem(g.where(_differs(no("union_sources"), c("expected_sources").cast("bigint")) | _differs(c("contributing_sources"), c("expected_sources"))), "source-counts"),
        _problem(both.where("least = most"), "source-sets"),
        _problem(missing(generations, "manifest_path"), "manifest-not-stored"),
        _problem(m.where(~F.coalesce(fine_master, F.lit(False))), "master"),
        _problem(m.where(_differs(c("object_id"), c("run_object"))), "master-object"),
        _problem(missing(masters, "fits_path"), "master-not-stored"),
        _problem(missing(masters, "preview_path"), "master-not-stored"),
    ]
    return reduce(DataFrame.unionByName, rules).groupBy("generation", "problem").agg(F.count(F.lit(1)).alias("n"))


def activated(generations: DataFrame, problems: DataFrame) -> DataFrame:
    """Generations after the switch: of each layer the highest sound one that is verifying becomes complete and current, the former current one retires, unsound ones fail."""
    broken = problems.groupBy("generation").agg(F.count(F.lit(1)).alias("broken"))
    rows = generations.join(broken, "generation", "left").withColumn("sound", F.col("broken").isNull())
    chosen = rows.where("sound and status = 'verifying'").groupBy("layer").agg(F.max("number").alias("winner"))
    rows = rows.join(chosen, "layer", "left")
    won = F.coalesce(F.col("number") == F.col("winner"), F.lit(False))
    status = F.when(won, "complete").when((F.col("status") == "verifying") & ~F.col("sound"), "failed").when((F.col("status") == "complete") & F.col("winner").isNotNull(), "retired").otherwise(F.col("status"))
    return rows.select("layer", "number", "generation", status.alias("status"), (won | (F.col("winner").isNull() & (F.col("status") == "complete"))).alias("is_current"))


def added_up(current: DataFrame, arrivals: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """An upsert that adds: counters of both tables by key."""
    return current.select(*key, *counters).unionByName(arrivals.select(*key, *counters)).groupBy(*key).agg(*(F.sum(n).alias(n) for n in counters))


def upserted_where(current: DataFrame, changes: DataFrame, key: str, replaceable: Column, columns: list[str]) -> DataFrame:
    """An upsert with a condition on the row that is there: new keys enter, old rows change only where they are replaceable."""
    old = current.select(key, *(F.col(n).alias(f"old_{n}") for n in columns), replaceable.alias("replaceable"), F.lit(True).alias("there"))
    new = changes.select(key, *(F.col(n).alias(f"new_{n}") for n in columns), F.lit(True).alias("changed"))
    take = F.coalesce("changed", F.lit(False)) & (F.col("there").isNull() | F.coalesce("replaceable", F.lit(False)))
    return old.join(new, key, "full").select(key, *(F.when(take, F.col(f"new_{n}")).otherwise(F.col(f"old_{n}")).alias(n) for n in columns), take.alias("changed"))


def rebuilt(current: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """Delete and insert again: the partitions that fresh has are replaced as a whole, others stay."""
    return current.join(fresh.select(partition).distinct(), partition, "left_anti").unionByName(fresh)


def duplicates_of(rows: DataFrame, condition: Column, key: list[str]) -> DataFrame:
    """Keys that break 'at most one row where the condition holds'."""
    return rows.where(condition).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def enqueued(rows: DataFrame, jobs: DataFrame, job_type: str, key: Column) -> DataFrame:
    """Jobs that inserted rows call for, by a key made of the row; keys that are there already call for none."""
    wanted = rows.select(key.alias("key"), F.lit(job_type).alias("job_type")).distinct()
    return wanted.join(jobs.select("key"), "key", "left_anti")


def claimed(candidates: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert what isn't taken, and book what was inserted: (inserted, ledger). candidates: cell, upload, user, points, at."""
    free = candidates.join(taken.select("cell"), "cell", "left_anti")
    inserted = free.groupBy("cell").agg(F.min(F.struct("at", "upload", "user", "points")).alias("r")).select("cell", "r.upload", "r.user", "r.points")
    ledger = inserted.where(F.col("user").isNotNull()).groupBy("user").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("cells"))
    return inserted, ledger


def counters_after(rows: DataFrame, inserts: DataFrame, deletes: DataFrame, key: str, counter: str) -> DataFrame:
    """What triggers leave of a counter: one more for each insert, one less for each delete, never below 0."""
    moves = inserts.select(key, F.lit(1).alias("by")).unionByName(deletes.select(key, F.lit(-1).alias("by"))).groupBy(key).agg(F.sum("by").alias("by"))
    return rows.join(moves, key, "left").select(key, F.greatest(F.lit(0), F.col(counter) + F.coalesce("by", F.lit(0))).alias(counter))
