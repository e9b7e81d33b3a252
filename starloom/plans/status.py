"""Public status, requests, favourites, dispatch and archive runs."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from starloom.functions import astro as A
from starloom.operators import archives as V
from starloom.operators import lookups as L
from starloom.operators import mosaic as M
from starloom.operators import rollups as R
from starloom.operators import status as P
from starloom.operators.jobs import TRANSITIONS
from starloom.plans.archives import VIEWED, views
from starloom.sources import tables as S

BASE = "https://sky.example"
NOW = dt.datetime(1998, 6, 1)


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(key, *values):
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def _id(key):
    return F.concat(F.lit("M"), key.cast("string"))


def _objects(s, d):
    return S.table(s, d, "part").select(_id(F.col("p_partkey")).alias("object_id"), (F.col("p_size") * 3).alias("total_lights"))


def q36_public_status(s, d):
    k = F.col("o_orderkey")
    runs = S.table(s, d, "orders").select(_id(k % 150).alias("object_id"), F.col("o_orderdate").alias("started_at"), k.alias("run_id"), _pick(k, "discovering", "complete", "failed", "unheard", "building", "cancelled").alias("state"), (k % 40).alias("total"), (k % 13).alias("published"), (k % 5).alias("rejected"), (k % 3).cast("int").alias("active"))
    b = F.col("s_suppkey")
    builds = S.table(s, d, "supplier").select(_id(b * 3).alias("object_id"), (b % 6).cast("int").alias("generation"), _pick(b, "building", "complete", "odd", "retired").alias("state"), (b % 50).alias("expected_tiles"), (b % 30).alias("published_tiles"))
    c = F.col("c_custkey")
    masters = S.table(s, d, "customer").select(_id(c).alias("object_id"), (c % 4).cast("int").alias("master_generation"), F.concat(F.lit("masters/m"), (c + F.when(c % 5 == 0, 1).otherwise(0)).cast("string"), _pick(c, "", "-r", "-r"), F.lit("/"), (c % 4).cast("string"), _pick(c, "/a b.fits", "/x.fits", "/../x.fits")).alias("fits_path"), F.when(c % 2 == 0, F.concat(F.lit("masters/p"), c.cast("string"), F.lit(".webp"))).alias("preview_path"))
    tiles = S.table(s, d, "lineitem").select(_id(F.col("l_suppkey") * 3).alias("object_id"), (F.col("l_suppkey") % 6).cast("int").alias("generation"), F.when(F.col("l_linenumber") < 5, F.concat(F.lit("hips/"), F.col("l_partkey").cast("string"), F.lit(".webp"))).alias("path"))
    return P.public_status(_objects(s, d), runs, builds, masters, tiles, BASE)


def e08_answered(s, d):
    e = F.col("event_id")
    given = F.when(e % 6 > 0, F.concat(_pick(e, "", " M", "M", "-M", "M ", "N"), (e % 250).cast("string"), F.when(e % 11 == 0, "é").otherwise(" ")))
    return P.answered(S.table(s, d, "events").select(e.alias("request_id"), given.alias("given")), _objects(s, d))


def e19_payload_codes(s, d):
    """Status payloads: 404 without an object, 503 for what is no valid payload."""
    e = F.col("event_id")
    body = _pick(e, '{"object": null}', '{"object": {"id": "M31"}}', '{"object": {}}', "{broken", "[1]")
    rows = S.table(s, d, "events").select("event_id", F.when(e % 7 > 0, body).alias("body"))
    v = F.try_parse_json("body")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.object", "variant"))
    return rows.select("event_id", F.when(kind == "VOID", 404).when(F.try_variant_get(v, "$.object.id", "string").isNotNull(), 200).otherwise(503).alias("status"))


def e01_cells(s, d):
    best = M.best_tiles(M.tiles(S.frames(s, d), S.objects(s, d))).select("order", "index", "path")
    k = F.col("p_partkey")
    cells = M.object_cells(S.objects(s, d), (8,)).select("object_id", "cell8")
    asked = S.table(s, d, "part").select(k.alias("object_id"), (k % 6 + 5).cast("int").alias("order")).join(cells, "object_id")
    indices = F.when(k % 7 == 0, F.array().cast("array<bigint>")).when(k % 11 == 0, F.array(F.col("cell8"), F.lit(-1))).otherwise(F.array("cell8", F.col("cell8") + 1, F.col("cell8")))
    rows = asked.withColumnRenamed("object_id", "p_partkey").select(F.col("p_partkey").alias("request_id"), "order", indices.alias("indices"))
    return P.answered_cells(rows, best, BASE)


def e06_own_uploads(s, d):
    requests = S.table(s, d, "orders").select(F.col("o_orderkey").alias("upload_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("viewer"))
    jobs = S.jobs(s, d).where("job_type = 'qualify'").select(F.col("job_id").alias("upload_id"), F.col("status").alias("job_status"))
    return P.own_uploads(S.uploads(s, d).select("upload_id", "user_id", "status"), jobs, requests)


def e04_cancelled(s, d):
    can = tuple(a for a, to in TRANSITIONS.items() if "cancelled" in to)
    requests = S.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("viewer"))
    return P.cancelled(S.jobs(s, d).select("job_id", "user_id", "status"), requests, can)


def e09_cluster_jobs(s, d):
    """Cluster requests for own observations: each key is queued once, whoever asks how often."""
    o = S.observations(s, d)
    requests = o.select("observation_id", F.when(F.col("observation_id") % 3 > 0, F.col("user_id")).otherwise(1).alias("viewer")).unionByName(o.where("observation_id % 2 = 0").select("observation_id", F.col("user_id").alias("viewer")))
    own = requests.join(o.select("observation_id", "user_id"), "observation_id").where("viewer = user_id")
    return own.select(F.concat(F.lit("cosmos-cluster:"), F.col("observation_id").cast("string")).alias("key"), "user_id").distinct()


def e11_object_search(s, d):
    """Objects whose name or family holds a text, most lights first."""
    stats = R.object_stats(S.frames(s, d)).select("object_id", "n_light")
    rows = S.objects(s, d).where(F.col("name").ilike("%li%") | F.col("family").ilike("%#1%")).join(stats, "object_id", "left").fillna(0, ["n_light"])
    return rows.select("object_id", "name", "n_light").orderBy(F.col("n_light").desc(), "object_id").limit(50)


def e12_merged(s, d):
    news = S.table(s, d, "supplier").select(_id(F.col("s_suppkey") * 2).alias("object_id"), (F.col("s_suppkey") * 7).cast("int").alias("total_lights"))
    return P.merged_status(_objects(s, d), news, ["total_lights"])


def e13_toggled(s, d):
    have = S.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("object_id"))
    toggles = S.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 20).alias("object_id"))
    return P.toggled(have, toggles)


def e14_viewport(s, d):
    """From views to their cells, each once, and their tiles."""
    cells = V.views_cells(views(s, d), 8).select("order", "index").distinct()
    return M.covered(cells, M.best_tiles(M.tiles(S.frames(s, d), S.objects(s, d)))).select("order", "index", "slug")


def e21_star_rows(s, d):
    """Rows of stars and planets for a catalogue: names and the least instrument."""
    k, m = F.col("p_partkey"), F.col("p_size") / 5.0
    bayer = F.when(k % 3 > 0, F.concat(_pick(k, "α", "β", "γ"), F.lit(" "), F.upper(F.left("p_name", F.lit(3)))))
    name = F.when(k % 4 == 0, F.initcap("p_name"))
    star = F.when(m <= 6, "oeil-nu").otherwise("jumelles")
    planet = F.when(m < 4, "oeil-nu").when(m < 8, "jumelles").otherwise("petit-telescope")
    return S.table(s, d, "part").select("p_partkey", F.coalesce(name, bayer, F.concat(F.lit("Étoile "), F.col("p_brand"))).alias("name"), star.alias("star"), planet.alias("planet"))


def e22_snapshot(s, d):
    """Sun, Moon and planets every six hours, with their elongation from the Sun."""
    from starloom.functions.geo import separation_deg
    from starloom.functions.maths import half_up

    t = s.range(200).select(F.timestamp_add("HOUR", (F.col("id") * 6).cast("int"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("at"))
    rows = A.with_planets(A.with_sun(t.withColumn("d", A.day_number(F.col("at")))))
    return rows.select("at", "planet", half_up(separation_deg(F.col("planet_ra"), F.col("planet_dec"), F.col("sun_ra"), F.col("sun_dec")), 5).alias("elongation"))


def e23_families(s, d):
    return S.objects(s, d).select("family").distinct().orderBy(F.collate("family", "fr")).select("family")


def e26_rebuild_guard(s, d):
    """Runs whose number of eligible frames is not the one expected."""
    eligible = S.frames(s, d).where(R.eligible()).groupBy("run_id").agg(F.count(F.lit(1)).alias("eligible"))
    expected = S.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 6).alias("expected"))
    return expected.join(eligible, "run_id", "left").select("run_id", "expected", F.coalesce("eligible", F.lit(0)).alias("eligible")).where("expected <> eligible")


def e28_run_updates(s, d):
    k = F.col("o_orderkey")
    rows = S.table(s, d, "orders").select(k.alias("run_id"), F.lit("qualifying").alias("state"), _pick(k, "complete", None, "building", "failed", "cancelled").alias("new"), F.when(k % 7 == 0, F.col("o_orderdate")).alias("ended"))
    state, ended = P.run_after(F.col("state"), F.col("new"), F.col("ended"), _now())
    return rows.select("run_id", state.alias("state"), ended.alias("ended"))


def e29_created_runs(s, d):
    """The newest run of each object that began after its request."""
    requests = S.table(s, d, "customer").select(F.col("c_custkey").alias("object_id"), F.lit(NOW).cast("timestamp_ntz").alias("asked_at"))
    runs = S.table(s, d, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("run_id"))
    met = runs.join(requests, "object_id").where("started_at >= asked_at")
    return P.latest(met.select("object_id", "started_at", "run_id"), "object_id", ["started_at", "run_id"])


def e30_pending(s, d):
    """Objects with a current master, and those of their newest jobs that are still open."""
    newest = P.latest(S.jobs(s, d).select("object_id", "available_at", "job_id", "status"), "object_id", ["available_at", "job_id"])
    have = S.table(s, d, "part").select((F.col("p_partkey") % 130).alias("object_id")).distinct()
    return newest.join(have, "object_id", "left_semi").where(~F.col("status").isin(*P.TERMINAL)).select("object_id", "job_id", "status")


def e31_targeted_leases(s, d):
    """Jobs of given ids that may be leased: of a scope, due, free, with attempts left."""
    asked = S.table(s, d, "part").select((F.col("p_partkey") * 4 % 1000).alias("job_id")).distinct()
    now = _now()
    due = S.jobs(s, d).where(F.col("job_type").isin("qualify", "publish") & ~F.col("status").isin(*P.TERMINAL) & (F.col("attempts") < F.col("max_attempts")) & (F.col("available_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") < now)))
    return due.join(asked, "job_id", "left_semi").select("job_id", (F.col("attempts") + 1).alias("attempts"))


def e32_spread_failures(s, d):
    k = F.col("job_id")
    failures = S.jobs(s, d).where("job_id % 2 = 0").select("job_id", F.lit("VALUEERROR").alias("code"), F.concat(F.lit("because of "), k.cast("string")).alias("detail"), F.when(k % 3 > 0, 60).alias("retry_after"))
    return P.failures_spread(S.jobs(s, d), failures)


def e34_next_numbers(s, d):
    """One more than the highest number of a layer's generations and of its object's masters."""
    layers = S.table(s, d, "supplier").select((F.col("s_suppkey") % 60).alias("layer")).distinct()
    generations = S.table(s, d, "orders").select((F.col("o_custkey") % 60).alias("layer"), (F.col("o_orderkey") % 30).cast("int").alias("generation"))
    masters = S.table(s, d, "part").select((F.col("p_partkey") % 60).alias("layer"), (F.col("p_partkey") % 35).cast("int").alias("generation"))
    return L.next_generation(layers, generations, masters, key="layer")


def e36_storage_roots(s, d):
    k = F.col("p_partkey")
    sha = F.sha2(k.cast("string"), 256)
    return S.table(s, d, "part").select("p_partkey", P.storage_root("hips/r", sha, (k % 10).cast("int"), {"moc_sha256": F.sha2(F.col("p_name"), 256), "preview_render_version": F.lit("v1")}).alias("root"))


def e37_content_types(s, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("a/"), k.cast("string"), _pick(k, ".fits", ".FIT", ".png", ".jpeg", ".json", "/properties", ".xml", ".html", ".txt", "", ".webp"))
    return S.table(s, d, "part").select("p_partkey", P.content_type(path).alias("content_type"))


def e43_ingestible(s, d):
    c = F.col("l_suppkey")
    candidates = S.table(s, d, "lineitem").groupBy(c.alias("target"), F.col("l_partkey").alias("record_id")).agg(F.min("l_orderkey").alias("place")).withColumn("redistributable", F.col("record_id") % 3 > 0)
    known = S.table(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("record_id"))
    return P.ingestible(candidates, known, 6)


def _seed_runs(s, d):
    k = F.col("o_orderkey")
    query = F.concat(F.lit('{"target_mode": "'), _pick(k, "sky_seed", "sky_seed", "object"), F.lit('", "seed_order": "'), _pick(F.floor(k / 3), "4", "4", "5"), F.lit('", "seed_index": "'), _pick(F.floor(k / 9), "", "", "x"), (k % 400).cast("string"), F.lit('"}'))
    return S.table(s, d, "orders").select(F.when(k % 8 == 0, _id(k)).alias("object_id"), _pick(k, "r", "r", "g", "r").alias("band"), query.alias("query"))


def e45_attempted_seeds(s, d):
    return P.attempted_seeds(_seed_runs(s, d), 4, "r")


def e46_reusable(s, d):
    u = S.uploads(s, d).withColumn("created_at", F.col("captured_at"))
    items = u.select(F.col("upload_id").alias("item_id"), "content_sha256")
    return P.reusable(items, u, "content_sha256")


def e49_current_layers(s, d):
    """Masters with their generations and layers, in some bands."""
    masters = S.jobs(s, d).where("status = 'published'").select("job_id", "object_id")
    generations = S.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 25).cast("int").alias("layer"))
    layers = S.table(s, d, "nation").select(F.col("n_nationkey").alias("layer"), F.col("n_name").alias("slug"), _pick(F.col("n_nationkey"), "g", "r", "i", "z", "y").alias("band"))
    return masters.join(generations, "job_id").join(layers.where(F.col("band").isin("r", "i")), "layer").select("job_id", "object_id", "slug", "band")


def e50_backfill(s, d):
    top = M.object_cells(S.objects(s, d), (7, 9))
    tiles = top.select(F.lit(9).alias("order"), F.col("cell9").alias("index")).unionByName(top.where("object_id % 3 = 0").select(F.lit(7).alias("order"), F.col("cell7").alias("index"))).distinct()
    return P.parent_backfill(tiles, 0)


def o01_dispatched(s, d):
    return P.dispatched(S.jobs(s, d).withColumn("retry_state", F.when(F.col("job_id") % 8 == 0, "approved").otherwise("uploaded")))


def o02_qualified(s, d):
    k = F.col("upload_id")
    rows = S.uploads(s, d).select("upload_id", (k % 7 > 0).alias("readable"), (k % 5 > 0).alias("solved"), (k % 3 > 0).alias("eligible"), (k % 11 == 0).alias("duplicate"))
    return P.staged_qualification(rows).select("upload_id", "status", "progress")


def o04_bounded_seeds(s, d):
    cells = s.range(192).select(F.col("id").alias("index")).withColumn("spread", F.sha2(F.concat(F.lit("seed:"), F.col("index").cast("string")), 256))
    outcomes = S.table(s, d, "part").where("p_partkey < 192").select(F.col("p_partkey").alias("index"), (F.col("p_partkey") % 9 == 0).alias("works"))
    return P.bounded_seeds(cells, outcomes, 40)


def o03_failed_states(s, d):
    """Failed jobs keep the state to take up again, wait longer each time, and end when no attempt is left."""
    jobs = S.jobs(s, d).where(F.col("status").isin("solving", "approved", "uploaded"))
    dead = F.col("attempts") >= F.col("max_attempts")
    delay = F.least(F.lit(900), F.pow(F.lit(2), F.least("attempts", F.lit(8)))).cast("int")
    return jobs.select("job_id", F.lit("failed").alias("status"), F.when(~dead, F.col("status")).alias("retry_state"), F.when(~dead, F.timestamp_add("SECOND", delay, _now())).alias("available_at"), F.when(dead, _now()).alias("completed_at"))


QUERIES = {
    f.__name__: f
    for f in (
        q36_public_status, e01_cells, e04_cancelled, e06_own_uploads, e08_answered, e09_cluster_jobs, e11_object_search, e12_merged, e13_toggled, e14_viewport, e19_payload_codes, e21_star_rows, e22_snapshot, e23_families, e26_rebuild_guard, e28_run_updates, e29_created_runs,
        e30_pending, e31_targeted_leases, e32_spread_failures, e34_next_numbers, e36_storage_roots, e37_content_types, e43_ingestible, e45_attempted_seeds, e46_reusable, e49_current_layers, e50_backfill, o01_dispatched, o02_qualified, o03_failed_states, o04_bounded_seeds,
    )
}

from starloom.plans.astro import _SUN  # noqa: E402
from starloom.plans.mosaic import _BASE, _COVER, _TILES  # noqa: E402

_CAN = ", ".join(f"'{a}'" for a, to in TRANSITIONS.items() if "cancelled" in to)
_OPEN = "status NOT IN ('published', 'rejected', 'duplicate', 'cancelled')"
_PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST(floor(least(greatest(({a}) * 100.0::DOUBLE / {b}, 0), 100) + 0.5) AS INT) ELSE 0 END"
_ELIGIBLE = "status IN ('approved', 'published', 'stacked') AND NOT rejected"

#: The views' own cells beside those of the objects: names of the CTEs that both have begin otherwise.
_VIEWED = re.sub(r"\b(ang|arms|caps|xy|cell|objects)\b", r"view_\1", VIEWED)

ORACLES = {
    "e14_viewport": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, {_TILES}, {_VIEWED}, asked AS (SELECT DISTINCT idx FROM viewed) SELECT 8 AS "order", idx AS index, coalesce(slug, 'uncovered') AS slug FROM asked LEFT JOIN best_tiles b ON b."order" = 8 AND b."index" = idx""",
    "q36_public_status": f"""WITH o AS (SELECT 'M' || p_partkey AS object_id, p_size * 3 AS total_lights FROM part), r AS (SELECT 'M' || o_orderkey % 150 AS object_id, (['discovering', 'complete', 'failed', 'unheard', 'building', 'cancelled'])[o_orderkey % 6 + 1] AS run_state, o_orderkey % 40 AS total, o_orderkey % 13 AS published, o_orderkey % 5 AS rejected, o_orderkey % 3 AS active
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 150 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), b AS (SELECT 'M' || s_suppkey * 3 AS object_id, s_suppkey % 6 AS generation, (['building', 'complete', 'odd', 'retired'])[s_suppkey % 4 + 1] AS build_state, s_suppkey % 50 AS expected_tiles, s_suppkey % 30 AS published_tiles FROM supplier),
        t AS (SELECT 'M' || l_suppkey * 3 AS object_id, least(count(*), 512) AS n_tiles FROM lineitem WHERE l_linenumber < 5 GROUP BY l_suppkey), m AS (SELECT 'M' || c_custkey AS object_id, c_custkey % 4 AS master_generation, CASE WHEN c_custkey % 3 = 0 THEN '{BASE}/storage/v1/object/public/astro-derived/masters/m' || c_custkey || '/' || c_custkey % 4 || '/a%20b.fits'
        WHEN c_custkey % 3 = 1 THEN '{BASE}/storage/v1/object/public/astro-derived/masters/m' || c_custkey || '-r/' || c_custkey % 4 || '/x.fits' END AS download_url, CASE WHEN c_custkey % 2 = 0 THEN '{BASE}/storage/v1/object/public/astro-derived/masters/p' || c_custkey || '.webp' END AS preview_url FROM customer WHERE c_custkey % 5 <> 0)
        SELECT o.object_id, CASE WHEN coalesce(run_state, '') = 'unheard' OR coalesce(build_state, '') = 'odd' THEN 503 ELSE 200 END AS status, total_lights, run_state, {_PCT("published + rejected", "total")} AS qualified_percent, build_state, {_PCT("published_tiles", "expected_tiles")} AS built_percent,
        coalesce(active > 0, false) OR coalesce(run_state IN ('discovering', 'building'), false) OR coalesce(build_state = 'building', false) AS is_active, coalesce(n_tiles, 0) AS n_tiles, master_generation, download_url, preview_url
        FROM o LEFT JOIN r USING (object_id) LEFT JOIN b USING (object_id) LEFT JOIN t USING (object_id) LEFT JOIN m USING (object_id)""",
    "e01_cells": f"""WITH {_BASE}, {S.FRAMES}, {_COVER}, {_TILES}, a AS (SELECT p_partkey AS request_id, p_partkey % 6 + 5 AS o, "index" >> 2 AS c FROM part JOIN cell ON object_id = p_partkey), v AS (SELECT *, o BETWEEN 6 AND 9 AND request_id % 7 <> 0 AND request_id % 11 <> 0 AS valid FROM a)
        SELECT request_id, 400 AS status, NULL::BIGINT AS index, NULL::VARCHAR AS tile_url FROM v WHERE NOT valid UNION ALL SELECT request_id, 200, b.index, '{BASE}/storage/v1/object/public/astro-derived/' || path FROM v, range(0, 2) r(k) JOIN best_tiles b ON b.order = o AND b.index = c + k WHERE valid""",
    "e04_cancelled": f"""WITH {S.JOBS} SELECT job_id, user_id + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS viewer, CASE WHEN job_id % 5 <> 0 AND status IN ({_CAN}) THEN 200 ELSE 409 END AS code, CASE WHEN job_id % 5 <> 0 AND status IN ({_CAN}) THEN 'cancelled' ELSE status END AS status FROM jobs WHERE job_id % 3 = 0""",
    "e06_own_uploads": f"""WITH {S.UPLOADS}, {S.JOBS}, v AS (SELECT o_orderkey AS upload_id, o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS viewer FROM orders) SELECT v.upload_id, viewer, CASE WHEN u.user_id = viewer THEN 200 ELSE 404 END AS code, CASE WHEN u.user_id = viewer THEN u.status END AS status, CASE WHEN u.user_id = viewer THEN j.status END AS job_status
        FROM v JOIN uploads u USING (upload_id) LEFT JOIN jobs j ON j.job_id = v.upload_id AND job_type = 'qualify'""",
    "e08_answered": """WITH r AS (SELECT event_id AS request_id, trim(coalesce(CASE WHEN event_id % 6 > 0 THEN (['', ' M', 'M', '-M', 'M ', 'N'])[event_id % 6 + 1] || event_id % 250 || CASE WHEN event_id % 11 = 0 THEN 'é' ELSE ' ' END END, 'M31')) AS n FROM events), v AS (SELECT request_id, CASE WHEN length(n) <= 50 AND regexp_full_match(n, '[A-Za-z0-9][A-Za-z0-9+_.-]*') THEN n END AS object_id FROM r)
        SELECT request_id, object_id, CASE WHEN object_id IS NULL THEN 400 WHEN object_id IN (SELECT 'M' || p_partkey FROM part) THEN 200 ELSE 404 END AS status FROM v""",
    "e09_cluster_jobs": f"WITH {S.OBSERVATIONS} SELECT 'cosmos-cluster:' || observation_id AS key, user_id FROM observations WHERE user_id IS NOT NULL AND (observation_id % 3 > 0 OR user_id = 1 OR observation_id % 2 = 0)",
    "e11_object_search": f"""WITH {S.FRAMES}, {S.OBJECTS}, st AS (SELECT object_id, count(*) FILTER (WHERE kind = 'light') AS n_light FROM frames WHERE {_ELIGIBLE} GROUP BY object_id) SELECT object_id, name, coalesce(n_light, 0) AS n_light FROM objects LEFT JOIN st USING (object_id) WHERE name ILIKE '%li%' OR family ILIKE '%#1%' ORDER BY 3 DESC, 1 LIMIT 50""",
    "e12_merged": "SELECT 'M' || p_partkey AS object_id, CAST(coalesce(s_suppkey * 7, p_size * 3) AS INT) AS total_lights FROM part LEFT JOIN supplier ON s_suppkey * 2 = p_partkey",
    "e13_toggled": "SELECT c_custkey AS user_id, c_custkey % 20 AS object_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = c_custkey % 20) THEN 'removed' ELSE 'added' END AS outcome FROM customer",
    "e19_payload_codes": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 503 ELSE ([404, 200, 503, 503, 503])[event_id % 5 + 1] END AS status FROM events",
    "e21_star_rows": """WITH p AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS m, CASE WHEN p_partkey % 4 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') WHEN p_partkey % 3 > 0 THEN (['α', 'β', 'γ'])[p_partkey % 3 + 1] || ' ' || upper(left(p_name, 3)) ELSE 'Étoile ' || p_brand END AS name FROM part)
        SELECT p_partkey, name, CASE WHEN m <= 6 THEN 'oeil-nu' ELSE 'jumelles' END AS star, CASE WHEN m < 4 THEN 'oeil-nu' WHEN m < 8 THEN 'jumelles' ELSE 'petit-telescope' END AS planet FROM p""",
    "e23_families": f"WITH {S.OBJECTS} SELECT DISTINCT family FROM objects",
    "e26_rebuild_guard": f"WITH {S.FRAMES}, e AS (SELECT run_id, count(*) AS eligible FROM frames WHERE {_ELIGIBLE} GROUP BY run_id) SELECT o_orderkey AS run_id, o_orderkey % 6 AS expected, coalesce(eligible, 0) AS eligible FROM orders LEFT JOIN e ON run_id = o_orderkey WHERE o_orderkey % 6 <> coalesce(eligible, 0)",
    "e28_run_updates": "SELECT o_orderkey AS run_id, coalesce((['complete', NULL, 'building', 'failed', 'cancelled'])[o_orderkey % 5 + 1], 'qualifying') AS state, CASE WHEN o_orderkey % 5 IN (0, 3, 4) THEN TIMESTAMP '1998-06-01' WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS ended FROM orders",
    "e29_created_runs": "SELECT o_custkey AS object_id, o_orderdate AS started_at, o_orderkey AS run_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "e30_pending": f"WITH {S.JOBS}, n AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY available_at DESC, job_id DESC) = 1) SELECT object_id, job_id, status FROM n WHERE {_OPEN} AND object_id IN (SELECT p_partkey % 130 FROM part)",
    "e31_targeted_leases": f"WITH {S.JOBS} SELECT job_id, attempts + 1 AS attempts FROM jobs WHERE job_id IN (SELECT p_partkey * 4 % 1000 FROM part) AND job_type IN ('qualify', 'publish') AND {_OPEN} AND attempts < max_attempts AND available_at <= TIMESTAMP '1998-06-01' AND (lease_until IS NULL OR lease_until < TIMESTAMP '1998-06-01')",
    "e32_spread_failures": f"""WITH {S.JOBS}, f AS (SELECT *, job_id % 3 = 0 OR attempts >= max_attempts AS terminal, 'because of ' || job_id AS why FROM jobs WHERE job_id % 2 = 0) SELECT job_id, 'upload' AS target, 'rejected' AS status, 'valueerror:' || why AS detail FROM f WHERE job_type = 'qualify' AND terminal
        UNION ALL SELECT job_id, 'stack', CASE WHEN terminal THEN 'failed' ELSE 'pending' END, why FROM f WHERE job_type = 'stack' UNION ALL SELECT job_id, 'generation', 'failed', 'VALUEERROR' FROM f WHERE job_type = 'publish' AND terminal UNION ALL SELECT job_id, 'run', 'failed', why FROM f WHERE job_type = 'publish' AND terminal""",
    "e34_next_numbers": "SELECT layer, coalesce(max(g), 0) + 1 AS next FROM (SELECT DISTINCT s_suppkey % 60 AS layer FROM supplier) LEFT JOIN (SELECT o_custkey % 60 AS layer, o_orderkey % 30 AS g FROM orders UNION ALL SELECT p_partkey % 60, p_partkey % 35 FROM part) USING (layer) GROUP BY layer",
    "e36_storage_roots": """WITH p AS (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS sha, p_partkey % 10 AS o, sha256(p_name) AS moc FROM part) SELECT p_partkey, 'hips/r/' || left(sha, 20) || '-' || left(sha256('{"hips_order":' || o || ',"inventory_sha256":"' || sha || '","moc_sha256":"' || moc || '","preview_render_version":"v1"}'), 12) || '-o' || o AS root FROM p""",
    "e37_content_types": "SELECT p_partkey, (['application/fits', 'application/fits', 'image/png', 'image/jpeg', 'application/json', 'text/plain', 'text/xml', 'text/html', 'text/plain', 'application/octet-stream', 'application/octet-stream'])[p_partkey % 11 + 1] AS content_type FROM part",
    "e43_ingestible": """WITH c AS (SELECT l_suppkey AS target, l_partkey AS record_id, min(l_orderkey) AS place FROM lineitem GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place, record_id) AS n FROM c), f AS (SELECT target, record_id, row_number() OVER (PARTITION BY target ORDER BY place, record_id) AS k FROM h WHERE n <= 48 AND record_id % 3 > 0 AND record_id % 5 <> 0) SELECT * FROM f WHERE k <= 6""",
    "e45_attempted_seeds": "SELECT DISTINCT o_orderkey % 400 AS index FROM orders WHERE o_orderkey % 8 <> 0 AND o_orderkey % 4 <> 2 AND o_orderkey % 3 < 2 AND o_orderkey // 3 % 3 < 2 AND o_orderkey // 9 % 3 < 2",
    "e46_reusable": f"WITH {S.UPLOADS}, e AS (SELECT content_sha256, arg_min(upload_id, (captured_at, upload_id)) AS reused_id FROM uploads WHERE source_kind = 'public_archive' AND {_ELIGIBLE} AND deleted_at IS NULL GROUP BY content_sha256) SELECT upload_id AS item_id, reused_id FROM uploads JOIN e USING (content_sha256) WHERE reused_id <> upload_id",
    "e49_current_layers": f"WITH {S.JOBS} SELECT job_id, object_id, n_name AS slug, (['g', 'r', 'i', 'z', 'y'])[n_nationkey % 5 + 1] AS band FROM jobs JOIN nation ON n_nationkey = user_id % 25 WHERE status = 'published' AND n_nationkey % 5 IN (1, 2)",
    "e50_backfill": f"""WITH {_BASE}, t AS (SELECT DISTINCT 9 AS o, "index" AS i FROM cell UNION SELECT 7, "index" >> 4 FROM cell WHERE object_id % 3 = 0), u AS (SELECT DISTINCT r.o AS o, t.i >> CAST(2 * (t.o - r.o) AS BIGINT) AS i FROM t, range(0, 9) r(o) WHERE r.o < t.o EXCEPT SELECT o, i FROM t)
        SELECT CAST(u.o AS INT) AS "order", u.i AS index, count(t.i) AS n_children FROM u LEFT JOIN t ON t.o = u.o + 1 AND t.i >> 2 = u.i GROUP BY ALL""",
    "o01_dispatched": f"""WITH {S.JOBS}, j AS (SELECT job_id, job_type, CASE WHEN status = 'failed' THEN CASE WHEN job_id % 8 = 0 THEN 'approved' ELSE 'uploaded' END ELSE status END AS state FROM jobs WHERE {_OPEN}) SELECT job_id, state, CASE job_type || ':' || state {" ".join(f"WHEN '{t}:{x}' THEN '{h}'" for (t, x), h in P.HANDLERS.items())} END AS handler FROM j""",
    "o02_qualified": """SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 11 = 0 THEN 'duplicate' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'published' END AS status,
        CASE WHEN o_orderkey % 11 = 0 THEN 100 WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 20 WHEN o_orderkey % 3 = 0 THEN 45 ELSE 100 END AS progress FROM orders""",
    "o03_failed_states": f"""WITH {S.JOBS} SELECT job_id, 'failed' AS status, CASE WHEN attempts < max_attempts THEN status END AS retry_state, CASE WHEN attempts < max_attempts THEN TIMESTAMP '1998-06-01' + to_seconds(CAST(least(900, pow(2, least(attempts, 8))) AS INT)) END AS available_at, CASE WHEN attempts >= max_attempts THEN TIMESTAMP '1998-06-01' END AS completed_at FROM jobs WHERE status IN ('solving', 'approved', 'uploaded')""",
    "o04_bounded_seeds": """WITH c AS (SELECT i AS index, sha256('seed:' || i) AS spread FROM range(0, 192) r(i) ORDER BY 2 LIMIT 40), o AS (SELECT c.*, coalesce(index % 9 = 0 AND index IN (SELECT p_partkey FROM part WHERE p_partkey < 192), false) AS works FROM c) SELECT * FROM o WHERE spread <= coalesce((SELECT min(spread) FROM o WHERE works), spread)""",
}
