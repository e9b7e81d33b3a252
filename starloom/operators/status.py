"""What the public may see: strict projections of objects, runs, builds, masters and tiles; requests answered row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import contracts as C
from starloom.functions import healpix as H
from starloom.functions.misc import percent
from starloom.operators.jobs import TERMINAL

OBJECT_ID = r"^[A-Za-z0-9][A-Za-z0-9+_.-]*$"
MOST_TILES, MOST_CELLS = 512, 1000
RUN_STATES = ("discovering", "downloading", "qualifying", "building", "complete", "failed", "cancelled")
BUILD_STATES = ("building", "verifying", "complete", "failed", "retired")


def requested_object(given: Column, default: str = "M31") -> Column:
    """The trimmed object id of a request, the default one if none is given; null for an id that is not valid."""
    name = F.trim(F.coalesce(given, F.lit(default)))
    return F.when((F.length(name) <= 50) & name.rlike(OBJECT_ID), name)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, by the columns of order, largest first."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def public_status(objects: DataFrame, runs: DataFrame, builds: DataFrame, masters: DataFrame, tiles: DataFrame, base: str) -> DataFrame:
    """One row an object with the allowed fields alone: its newest run, its newest build, and a master that is its own.

    A master is shown if its file stands under the object's own folder and the generation's; addresses are null for unsafe
    paths. status is 503 for a state that no contract knows. n_tiles: public tiles of the build, MOST_TILES at most.
    """
    run = latest(runs, "object_id", ["started_at", "run_id"]).select("object_id", F.col("state").alias("run_state"), "total", "published", "rejected", "active")
    build = latest(builds, "object_id", ["generation"]).select("object_id", "generation", F.col("state").alias("build_state"), "expected_tiles", "published_tiles")
    shown = tiles.where(C.published_tile(F.col("path"))).groupBy("object_id", "generation").agg(F.least(F.count(F.lit(1)), F.lit(MOST_TILES)).alias("n_tiles"))
    own = masters.where(C.master_path_fits(F.col("fits_path"), F.col("object_id"), F.col("master_generation")))
    out = objects.join(run, "object_id", "left").join(build, "object_id", "left").join(shown, ["object_id", "generation"], "left").join(own, "object_id", "left")
    known = (F.col("run_state").isNull() | F.col("run_state").isin(*RUN_STATES)) & (F.col("build_state").isNull() | F.col("build_state").isin(*BUILD_STATES))
    return out.select(
        "object_id",
        F.when(known, 200).otherwise(503).alias("status"),
        "total_lights",
        "run_state",
        percent(F.col("published") + F.col("rejected"), F.col("total")).alias("qualified_percent"),
        "build_state",
        percent(F.col("published_tiles"), F.col("expected_tiles")).alias("built_percent"),
        C.is_active(F.col("active"), F.col("run_state"), F.col("build_state")).alias("is_active"),
        F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"),
        "master_generation",
        C.derivative_url(F.lit(base), F.col("fits_path"), "masters/", ".fits").alias("download_url"),
        C.derivative_url(F.lit(base), F.col("preview_path"), "masters/", ".webp").alias("preview_url"),
    )


def answered(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (request_id, given) with the object they mean and 200, 400 (no valid id) or 404 (unknown)."""
    rows = requests.withColumn("object_id", requested_object(F.col("given")))
    found = known.select("object_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("object_id").isNull(), 400).when(F.col("known"), 200).otherwise(404)
    return rows.join(found, "object_id", "left").select("request_id", "object_id", status.alias("status"))


def cell_request_valid(order: Column, indices: Column) -> Column:
    """Orders 6 to 9, and 1 to MOST_CELLS indices that aren't negative."""
    return F.coalesce(order.between(6, 9) & F.size(indices).between(1, MOST_CELLS) & F.forall(indices, lambda i: i.isNotNull() & (i >= 0)), F.lit(False))


def answered_cells(requests: DataFrame, best: DataFrame, base: str) -> DataFrame:
    """A row for each cell of a valid request that has a tile, with its public address; 400 for invalid requests."""
    rows = requests.withColumn("valid", cell_request_valid(F.col("order"), F.col("indices")))
    bad = rows.where(~F.col("valid")).select("request_id", F.lit(400).alias("status"), F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("string").alias("tile_url"))
    asked = rows.where("valid").select("request_id", "order", F.explode(F.array_distinct("indices")).alias("index"))
    url = F.concat(F.lit(f"{base}/storage/v1/object/public/astro-derived/"), F.col("path"))
    return bad.unionByName(asked.join(best, ["order", "index"]).select("request_id", F.lit(200).alias("status"), "index", url.alias("tile_url")))


def tile_target(order: Column, path: Column, least: int = 6) -> Column:
    """Where a tile request leads: not-found, uncovered (low orders and cells without a published tile), or the tile's path."""
    return F.when(order.isNull(), "not-found").when((order < least) | ~C.published_tile(path), "uncovered").otherwise(path)


def own_uploads(uploads: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (upload_id, viewer) with the upload and its job: 404 for what isn't the viewer's own."""
    rows = requests.join(uploads, "upload_id", "left").join(jobs, "upload_id", "left")
    own = F.coalesce(F.col("user_id") == F.col("viewer"), F.lit(False))
    return rows.select("upload_id", "viewer", F.when(own, 200).otherwise(404).alias("code"), F.when(own, F.col("status")).alias("status"), F.when(own, F.col("job_status")).alias("job_status"))


def cancelled(jobs: DataFrame, requests: DataFrame, cancellable: tuple[str, ...]) -> DataFrame:
    """requests (job_id, viewer): 200 and the job cancelled, or 409 where it is another's or can't be cancelled any more."""
    rows = requests.join(jobs, "job_id", "left")
    can = F.coalesce((F.col("user_id") == F.col("viewer")) & F.col("status").isin(*cancellable), F.lit(False))
    return rows.select("job_id", "viewer", F.when(can, 200).otherwise(409).alias("code"), F.when(can, "cancelled").otherwise(F.col("status")).alias("status"))


def toggled(favourites: DataFrame, toggles: DataFrame) -> DataFrame:
    """toggles (user_id, object_id): removed where it was there, else added. Each pair once."""
    have = favourites.select("user_id", "object_id").distinct().withColumn("there", F.lit(True))
    rows = toggles.select("user_id", "object_id").distinct().join(have, ["user_id", "object_id"], "left")
    return rows.select("user_id", "object_id", F.when(F.col("there"), "removed").otherwise("added").alias("outcome"))


def merged_status(objects: DataFrame, news: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with the fields of the news that came for them; others stay as they are."""
    new = news.select("object_id", *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("came"))
    return objects.join(new, "object_id", "left").select("object_id", *(F.when(F.col("came"), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def run_after(state: Column, new: Column, ended: Column, now: Column) -> tuple[Column, Column]:
    """State and end of a run after an update: a null update keeps the state; only a last state sets the end."""
    return F.coalesce(new, state), F.when(F.coalesce(new.isin("complete", "failed", "cancelled"), F.lit(False)), now).otherwise(ended)


def failures_spread(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """What a failure leaves in the tables that hang on its job: (job_id, target, status, detail), a row for each table touched."""
    rows = jobs.join(failures, "job_id").withColumn("terminal", F.col("retry_after").isNull() | (F.col("attempts") >= F.col("max_attempts")))
    reason = F.left(F.concat_ws(":", F.lower("code"), F.col("detail")), F.lit(500))
    upload = rows.where("job_type = 'qualify' and terminal").select("job_id", F.lit("upload").alias("target"), F.lit("rejected").alias("status"), reason.alias("detail"))
    stack = rows.where("job_type = 'stack'").select("job_id", F.lit("stack").alias("target"), F.when(F.col("terminal"), "failed").otherwise("pending").alias("status"), F.left("detail", F.lit(2000)).alias("detail"))
    publish = rows.where("job_type = 'publish' and terminal")
    generation = publish.select("job_id", F.lit("generation").alias("target"), F.lit("failed").alias("status"), F.left("code", F.lit(100)).alias("detail"))
    run = publish.select("job_id", F.lit("run").alias("target"), F.lit("failed").alias("status"), F.left("detail", F.lit(2000)).alias("detail"))
    return upload.unionByName(stack).unionByName(generation).unionByName(run)


def staged_qualification(uploads: DataFrame) -> DataFrame:
    """Uploads led through all stages, as far as each gets: extracting (20), solving (45), qualifying (75), approved (90) or rejected, published (100).

    readable, solved, eligible, duplicate: what each stage finds out. A stage is a projection; nothing is shuffled.
    """
    stages = [("extracting", 20, F.col("readable")), ("solving", 45, F.col("solved")), ("qualifying", 75, F.col("eligible"))]
    out = uploads.withColumns({"status": F.when(F.col("duplicate"), "duplicate").otherwise("uploaded"), "progress": F.when(F.col("duplicate"), 100).otherwise(0)})
    open_ = ~F.col("status").isin("duplicate", "failed", "rejected")
    for name, progress, ok in stages:
        bad = "rejected" if name == "qualifying" else "failed"
        out = out.withColumns({"status": F.when(open_ & ok, name).when(open_, bad).otherwise(F.col("status")), "progress": F.when(open_ & ok, progress).otherwise(F.col("progress"))})
    return out.withColumns({"status": F.when(open_, "published").otherwise(F.col("status")), "progress": F.when(open_, 100).otherwise(F.col("progress"))})


#: What a worker does with a job, by type and status.
HANDLERS = {("qualify", "uploaded"): "extract", ("qualify", "solving"): "solve", ("qualify", "approved"): "publish-upload", ("stack", "uploaded"): "prepare-stack", ("stack", "approved"): "stack", ("publish", "approved"): "activate"}


def dispatched(jobs: DataFrame) -> DataFrame:
    """Open jobs with the handler of their type and status; none where there is no handler. A failed job is taken up in the state that it failed in."""
    keys = F.create_map(*(F.lit(x) for (t, s), h in HANDLERS.items() for x in (f"{t}:{s}", h)))
    state = F.when(F.col("status") == "failed", F.col("retry_state")).otherwise(F.col("status"))
    rows = jobs.where(~F.col("status").isin(*TERMINAL)).withColumn("state", state)
    return rows.select("job_id", "state", keys[F.concat_ws(":", "job_type", "state")].alias("handler"))


def bounded_seeds(spread: DataFrame, outcomes: DataFrame, tries: int) -> DataFrame:
    """Of the first tries seeds in their order, those up to the first that works: earlier ones are skipped for a recoverable failure."""
    first = spread.orderBy("spread").limit(tries).join(outcomes, "index", "left")
    works = first.where("works").agg(F.min("spread").alias("winner"))
    return first.join(works, F.lit(True)).where(F.col("winner").isNull() | (F.col("spread") <= F.col("winner"))).select("index", "spread", F.coalesce("works", F.lit(False)).alias("works"))


def attempted_seeds(runs: DataFrame, order: int, band: str) -> DataFrame:
    """Seed cells that runs without an object have tried, from their JSON query; an index that is no number is none."""
    q = lambda k: F.get_json_object("query", f"$.{k}")
    tried = runs.where(F.col("object_id").isNull() & (F.col("band") == band) & (q("target_mode") == "sky_seed") & (q("seed_order") == str(order)) & q("seed_index").rlike("^[0-9]+$"))
    return tried.select(q("seed_index").cast("bigint").alias("index")).distinct()


def content_type(path: Column) -> Column:
    """By the file's ending."""
    ending, name = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.substring_index(path, "/", -1)
    plain = {".txt": "text/plain", ".xml": "text/xml", ".html": "text/html"}
    out = F.when(ending.isin(".fits", ".fit", ".fts"), "application/fits").when(ending == ".png", "image/png").when(ending.isin(".jpg", ".jpeg"), "image/jpeg").when(ending == ".json", "application/json").when(name == "properties", "text/plain")
    for suffix, kind in plain.items():
        out = out.when(ending == suffix, kind)
    return out.otherwise("application/octet-stream")


def storage_root(prefix: str, inventory: Column, order: Column, parts: dict[str, Column]) -> Column:
    """A folder named by the inventory and by a hash over all that shapes its content, keys in order."""
    named = {"hips_order": order, "inventory_sha256": inventory, **parts}
    identity = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), named[k].cast("string") if k == "hips_order" else F.concat(F.lit('"'), named[k], F.lit('"'))) for k in sorted(named))), F.lit("}"))
    return F.concat(F.lit(f"{prefix}/"), F.left(inventory, F.lit(20)), F.lit("-"), F.left(F.sha2(identity, 256), F.lit(12)), F.lit("-o"), order.cast("string"))


def reusable(items: DataFrame, uploads: DataFrame, by: str) -> DataFrame:
    """Items with the earliest sound upload of another item of the same record or checksum."""
    sound = uploads.where((F.col("source_kind") == "public_archive") & F.col("status").isin("approved", "published", "stacked") & ~F.col("rejected") & F.col("deleted_at").isNull())
    earliest = sound.groupBy(by).agg(F.min(F.struct("created_at", "upload_id")).alias("e"))
    return items.join(earliest, by).where(F.col("e.upload_id") != F.col("item_id")).select("item_id", F.col("e.upload_id").alias("reused_id"))


def ingestible(candidates: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """New candidates to take of each target: of the first 8 n in their order, those that are not known and may be redistributed, n at most."""
    from pyspark.sql import Window as W

    own = W.partitionBy("target").orderBy("place", "record_id")
    head = candidates.withColumn("k", F.row_number().over(own)).where(F.col("k") <= 8 * n)
    fresh = head.where("redistributable").join(known.select("record_id"), "record_id", "left_anti")
    return fresh.withColumn("k", F.row_number().over(own)).where(F.col("k") <= n).select("target", "record_id", "k")


def parent_backfill(tiles: DataFrame, lowest: int) -> DataFrame:
    """Ancestors (order, index) that tiles lack, down to the lowest order, with how many of their children are there."""
    up = tiles.select("order", "index").distinct().withColumn("o", F.explode(F.sequence(F.lit(lowest), F.col("order") - 1))).where("o < order")
    lack = up.select(F.col("o").alias("order"), F.expr("shiftright(index, 2 * (order - o))").alias("index")).distinct().join(tiles.select("order", "index"), ["order", "index"], "left_anti")
    children = tiles.select((F.col("order") - 1).alias("order"), H.parent(F.col("index")).alias("index"), F.col("index").alias("child")).distinct().groupBy("order", "index").agg(F.count(F.lit(1)).alias("n_children"))
    return lack.join(children, ["order", "index"], "left").select("order", "index", F.coalesce("n_children", F.lit(0)).alias("n_children"))
