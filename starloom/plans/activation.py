"""Activation with all integrity rules, and changes as new versions of tables.

The stand-in has one generation a nation; each of its last digits breaks a rule.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.operators import activation as A
from starloom.operators import mosaic as M
from starloom.sources import tables as S
from starloom.sources.publication import Published
from starloom.sources.storage import scratch, written

def _plan(s, d):
    top = M.object_cells(S.objects(s, d), (9,)).select((F.col("object_id") % 25).cast("int").alias("generation"), F.col("cell9").alias("index")).distinct()
    every = top.select("generation", F.explode(F.sequence(F.lit(6), F.lit(9))).alias("order"), "index")
    return every.select("generation", "order", F.expr("shiftright(index, 2 * (9 - order))").alias("index")).distinct()


def _tiles(plan):
    kept = plan.where(((F.col("index") * 4 + F.col("order")) % 23 != 0) | (F.col("generation") % 3 != 0))
    more = plan.where((F.col("generation") % 5 == 0) & (F.col("order") == 9) & (F.col("index") % 31 == 0)).select("generation", "order", (F.col("index") + 1).alias("index"))
    t, i = kept.unionByName(more), F.col("index")
    sources = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("generation") * 10 + k), lambda x: (x + i) % 3 != 0)
    t = t.withColumn("sources", sources)
    weighed = F.filter("sources", lambda x: ~((F.col("generation") % 7 == 0) & (x % 5 == 0) & (i % 11 == 0)))
    sha = F.when((F.col("generation") % 8 == 1) & (i % 13 == 0), "bad").otherwise(F.sha2(i.cast("string"), 256))
    return t.withColumns({"sha256": sha, "path": H.tile_path("sky-r", 1, F.col("order"), i), "weights": F.map_from_arrays(weighed, F.transform(weighed, lambda x: x / 10.0))})


def _inventory(s, d):
    rows = S.table(s, d, "nation").select(F.col("n_nationkey").alias("generation"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return rows.select("generation", (F.col("generation") * 10 + F.col("k")).alias("source"), (F.col("k") * 60.0).alias("exposure_s"), F.when((F.col("generation") % 10 == 3) & (F.col("k") == 2), 0).otherwise(4).alias("eligible_cells"), F.when((F.col("generation") % 11 == 4) & (F.col("k") == 1), "v8").otherwise("v9").alias("solution_version"))


def _generations(s, d, plan):
    n = plan.groupBy("generation").agg(F.count(F.lit(1)).cast("int").alias("tiles"))
    sha = A.plan_sha256(plan).withColumnRenamed("sha256", "own_sha")
    ids = F.concat(F.array_join(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("generation") * 10 + k).cast("string"))), "\n"), F.lit("\n"))
    rows = S.table(s, d, "nation").select(F.col("n_nationkey").alias("generation")).join(n, "generation").join(sha, "generation")
    off = lambda m, r: F.when(F.col("generation") % m == r, 1).otherwise(0)
    return rows.select(
        "generation", F.concat(F.lit("O"), F.col("generation").cast("string")).alias("object_id"), F.lit("v9").alias("version"), F.when(F.col("generation") % 12 == 5, "building").otherwise("verifying").alias("status"), F.lit(True).alias("locked"),
        F.concat(F.lit("hips/m"), F.col("generation").cast("string"), F.lit(".json")).alias("manifest_path"), F.sha2(F.lit("m"), 256).alias("manifest_sha256"), F.lit(0).alias("failed_tiles"), F.lit(True).alias("validated"),
        F.when(F.col("generation") % 16 == 9, "stale").otherwise(F.col("own_sha")).alias("plan_sha256"), (F.col("tiles") + off(13, 6)).alias("planned_tiles"), F.col("tiles").alias("expected_tiles"), F.col("tiles").alias("published_tiles"),
        (F.lit(5) + off(14, 7)).alias("expected_sources"), F.lit(5).alias("contributing_sources"), F.when(F.col("generation") % 15 == 8, "old").otherwise(F.sha2(ids, 256)).alias("inventory_sha256"),
    )


def _masters(s, d):
    rows = S.table(s, d, "nation").select(F.col("n_nationkey").alias("generation"))
    path = lambda kind: F.concat(F.lit(f"masters/{kind}"), F.col("generation").cast("string"))
    return rows.select(
        "generation", F.concat(F.lit("O"), (F.col("generation") + F.when(F.col("generation") % 20 == 13, 1).otherwise(0)).cast("string")).alias("object_id"), (F.col("generation") % 18 == 11).alias("is_current"), F.lit(5).alias("lights"), F.lit(600.0 / 3600).alias("hours"), path("f").alias("fits_path"),
        F.when(F.col("generation") % 19 == 12, "bad").otherwise(F.sha2(F.lit("f"), 256)).alias("fits_sha256"), path("p").alias("preview_path"), F.sha2(F.lit("p"), 256).alias("preview_sha256"), (1 - F.col("generation") % 2 / 2.0).alias("covered"), (F.col("generation") % 4 != 3).alias("partial"), F.lit(0.25).alias("scale"), F.lit(100).alias("width"), F.lit(80).alias("height"),
    )


def _stored(tiles, generations, masters):
    some = tiles.where(~((F.col("generation") % 9 == 2) & (F.col("index") % 17 == 0))).select("path")
    manifests = generations.where(F.col("generation") % 17 != 10).select(F.col("manifest_path").alias("path"))
    files = masters.select(F.col("fits_path").alias("path")).unionByName(masters.where(F.col("generation") % 21 != 14).select(F.col("preview_path").alias("path")))
    return some.unionByName(manifests).unionByName(files)


def q22_activation_problems(s, d):
    plan = written(_plan(s, d), "plan")
    tiles, generations, masters = written(_tiles(plan), "tiles"), written(_generations(s, d, plan), "generations"), _masters(s, d)
    return A.activation_problems(generations, plan, tiles, _inventory(s, d), _stored(tiles, generations, masters), masters)


def q21_activated(s, d):
    k = F.col("o_orderkey")
    number = F.row_number().over(W.partitionBy("layer").orderBy("generation"))
    rows = S.table(s, d, "orders").select((F.col("o_custkey") % 60).alias("layer"), k.alias("generation"), F.when(k % 5 == 0, "complete").when(k % 5 < 4, "verifying").otherwise("building").alias("status")).withColumn("number", number)
    problems = S.table(s, d, "lineitem").where("l_quantity > 35").select(F.col("l_orderkey").alias("generation"), F.lit("inventory").alias("problem"))
    # published as a whole, and read through the pointer
    after, place = A.activated(rows, problems), Published(s, scratch(s, "activated"))
    place.publish(written(after, "after"))
    return place.read(after.schema)


def u3_added_up(s, d):
    f = S.frames(s, d)
    now = f.where("line <= 3").groupBy("object_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("exposure_s").alias("exposure"))
    new = f.where("line > 3").groupBy("object_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("exposure_s").alias("exposure"))
    return A.added_up(now, new, ["object_id"], ["frames", "exposure"])


def u4_conditional_upsert(s, d):
    """Failed jobs take the new row, others stay, unknown ones enter."""
    jobs = S.jobs(s, d).select("job_id", "status", "attempts")
    changes = S.table(s, d, "part").select((F.col("p_partkey") * 9).alias("job_id"), F.lit("uploaded").alias("status"), F.lit(0).alias("attempts"))
    return A.upserted_where(jobs, changes, "job_id", F.col("status") == "failed", ["status", "attempts"])


def u6_claim_chain(s, d):
    """Cells inserted and points booked, by contributor."""
    cells = M.frame_cells(S.frames(s, d), S.objects(s, d), (8, 9)).select(F.concat_ws(":", F.col("order").cast("string"), F.col("index").cast("string")).alias("cell"), F.col("frame_id").alias("upload"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user"), (F.col("order") * 2).alias("points"), "at")
    taken = M.object_cells(S.objects(s, d).where("object_id % 6 = 0"), (9,)).select(F.concat(F.lit("9:"), F.col("cell9").cast("string")).alias("cell"))
    return A.claimed(cells, taken)[1]


def u7_rebuilt(s, d):
    now = S.frames(s, d).groupBy("object_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    fresh = S.frames(s, d).where("object_id % 7 = 0 and not rejected").groupBy("object_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return A.rebuilt(now, fresh, "object_id")


def u8_counters(s, d):
    """Like counters after inserts and deletes."""
    posts = S.posts(s, d).select("post_id", (F.col("post_id") % 4).alias("likes"))
    likes = S.likes(s, d)
    return A.counters_after(posts, likes.where("user_id % 3 = 0"), likes.where("user_id % 3 = 1"), "post_id", "likes")


def a21_event_counts(s, d):
    """How many observations each hour's event has after some moved to the next hour's."""
    o = S.observations(s, d).withColumn("event", F.date_trunc("hour", "observed_at").cast("timestamp_ntz"))
    now = o.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    moved = o.where("observation_id % 5 = 0")
    return A.counters_after(now, moved.select((F.col("event") + F.expr("INTERVAL 1 HOUR")).alias("event")), moved.select("event"), "event", "n")


def u9_two_current(s, d):
    """Objects with more than one open stack job."""
    return A.duplicates_of(S.jobs(s, d), (F.col("job_type") == "stack") & ~F.col("status").isin("published", "failed"), ["object_id"])


def u10_enqueued(s, d):
    key = F.concat(F.lit("cluster:"), F.col("observation_id").cast("string"))
    there = S.table(s, d, "part").select(F.concat(F.lit("cluster:"), (F.col("p_partkey") * 3).cast("string")).alias("key"))
    return A.enqueued(S.observations(s, d).where("status <> 'rejected'"), there, "cluster", key)


def o05_replay(s, d):
    """Layers whose inventory is as stored need no work; others are built again."""
    f = S.frames(s, d)
    now = f.groupBy(F.col("object_id").alias("layer")).agg(F.sum(F.xxhash64("frame_id").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    before = f.where("object_id % 4 > 0 or line < 7").groupBy(F.col("object_id").alias("layer")).agg(F.sum(F.xxhash64("frame_id").cast("decimal(38,0)")).alias("old_h"), F.count(F.lit(1)).alias("old_n"))
    same = F.coalesce((F.col("h") == F.col("old_h")) & (F.col("n") == F.col("old_n")), F.lit(False))
    return now.join(before, "layer", "left").select("layer", "n", F.when(same, "replay").otherwise("build").alias("action"))


QUERIES = {f.__name__: f for f in (q22_activation_problems, q21_activated, u3_added_up, u4_conditional_upsert, u6_claim_chain, u7_rebuilt, u8_counters, a21_event_counts, u9_two_current, u10_enqueued, o05_replay)}

from starloom.plans.mosaic import _BASE, _COVER  # noqa: E402

_STAGED = f"""{_BASE}, plan AS (SELECT DISTINCT CAST(object_id % 25 AS INT) AS g, CAST(o AS INT) AS "order", "index" >> CAST(2 * (9 - o) AS BIGINT) AS "index" FROM cell, range(6, 10) r(o)),
 t0 AS (SELECT * FROM plan WHERE ("index" * 4 + "order") % 23 <> 0 OR g % 3 <> 0 UNION ALL SELECT g, "order", "index" + 1 FROM plan WHERE g % 5 = 0 AND "order" = 9 AND "index" % 31 = 0),
 used AS (SELECT g, "order", "index", g * 10 + k AS source FROM t0, range(0, 5) r(k) WHERE (g * 10 + k + "index") % 3 <> 0),
 counts AS (SELECT g, count(*) AS n, min("order") AS low, max("order") AS high, sha256('[' || string_agg('{{"index": ' || "index" || ', "order": ' || "order" || '}}', ', ' ORDER BY "order", "index") || ']') AS sha FROM plan GROUP BY g),
 actual AS (SELECT g, count(*) AS n, count(DISTINCT ("order", "index")) AS cells FROM t0 GROUP BY g), gens AS (SELECT g, n, low, high, a.n AS tiles, a.cells FROM counts LEFT JOIN actual a USING (g))"""
_STAGED = _STAGED.replace("SELECT g, n, low, high, a.n AS tiles, a.cells FROM counts LEFT JOIN actual a USING (g)", "SELECT c.g, c.n, low, high, a.n AS tiles, a.cells FROM counts c LEFT JOIN actual a ON a.g = c.g")

ORACLES = {
    "q22_activation_problems": f"""WITH {_STAGED}, p AS (
        SELECT g, 'not-ready' AS problem FROM gens WHERE g % 12 = 5 UNION ALL SELECT g, 'plan-hash' FROM gens WHERE g % 16 = 9 UNION ALL SELECT g, 'planned-counts' FROM gens WHERE g % 13 = 6
        UNION ALL SELECT c.g, 'no-parent' FROM plan c WHERE "order" > 6 AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.g = c.g AND p."order" = c."order" - 1 AND p."index" = c."index" // 4)
        UNION ALL SELECT c.g, 'no-child' FROM plan c WHERE "order" < 9 AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.g = c.g AND p."order" = c."order" + 1 AND p."index" // 4 = c."index")
        UNION ALL SELECT g, 'inventory' FROM gens WHERE g % 14 = 7 OR g % 15 = 8 UNION ALL SELECT g, 'source-without-cell' FROM gens WHERE g % 10 = 3 UNION ALL SELECT g, 'solution-version' FROM gens WHERE g % 11 = 4
        UNION ALL SELECT g, 'tile-counts' FROM gens WHERE coalesce(tiles, 0) <> n OR coalesce(cells, 0) <> n
        UNION ALL SELECT g, 'tile-missing' FROM (SELECT * FROM plan EXCEPT SELECT * FROM t0) UNION ALL SELECT g, 'tile-unexpected' FROM (SELECT * FROM t0 EXCEPT SELECT * FROM plan)
        UNION ALL SELECT g, 'tile-artefact' FROM t0 WHERE g % 8 = 1 AND "index" % 13 = 0 UNION ALL SELECT g, 'tile-not-stored' FROM t0 t WHERE g % 9 = 2 AND "index" % 17 = 0 AND NOT EXISTS (SELECT 1 FROM t0 o WHERE o."order" = t."order" AND o."index" = t."index" AND o.g % 9 <> 2)
        UNION ALL SELECT g, 'no-weight' FROM used WHERE g % 7 = 0 AND source % 5 = 0 AND "index" % 11 = 0
        UNION ALL SELECT g, 'source-counts' FROM gens LEFT JOIN (SELECT g, count(DISTINCT source) AS u FROM used GROUP BY g) USING (g) WHERE g % 14 = 7 OR coalesce(u, 0) <> 5
        UNION ALL SELECT g, 'source-sets' FROM (SELECT g, g * 10 + k AS source FROM gens, range(0, 5) r(k) EXCEPT SELECT g, source FROM used)
        UNION ALL SELECT g, 'manifest-not-stored' FROM gens WHERE g % 17 = 10 UNION ALL SELECT g, 'master' FROM gens WHERE g % 18 = 11 OR g % 14 = 7 OR g % 19 = 12 OR g % 4 = 3 UNION ALL SELECT g, 'master-object' FROM gens WHERE g % 20 = 13 UNION ALL SELECT g, 'master-not-stored' FROM gens WHERE g % 21 = 14)
        SELECT g AS generation, problem, count(*) AS n FROM p GROUP BY ALL""",
    "q21_activated": """WITH r AS (SELECT o_custkey % 60 AS layer, o_orderkey AS generation, CASE WHEN o_orderkey % 5 = 0 THEN 'complete' WHEN o_orderkey % 5 < 4 THEN 'verifying' ELSE 'building' END AS status, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 35) AS bad FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY generation) AS number FROM r), w AS (SELECT *, max(number) FILTER (WHERE NOT bad AND status = 'verifying') OVER (PARTITION BY layer) AS winner FROM n)
        SELECT layer, number, generation, CASE WHEN number = winner THEN 'complete' WHEN status = 'verifying' AND bad THEN 'failed' WHEN status = 'complete' AND winner IS NOT NULL THEN 'retired' ELSE status END AS status, coalesce(number = winner, status = 'complete') AS is_current FROM w""",
    "u3_added_up": f"WITH {S.FRAMES} SELECT object_id, CAST(count(*) AS BIGINT) AS frames, sum(exposure_s) AS exposure FROM frames GROUP BY object_id",
    "u4_conditional_upsert": f"""WITH {S.JOBS}, c AS (SELECT p_partkey * 9 AS job_id FROM part), j AS (SELECT coalesce(jobs.job_id, c.job_id) AS job_id, status, attempts, c.job_id IS NOT NULL AND (jobs.job_id IS NULL OR status = 'failed') AS changed FROM jobs FULL JOIN c ON c.job_id = jobs.job_id)
        SELECT job_id, CASE WHEN changed THEN 'uploaded' ELSE status END AS status, CASE WHEN changed THEN 0 ELSE attempts END AS attempts, changed FROM j""",
    "u6_claim_chain": f"""WITH {_BASE}, {S.FRAMES}, {_COVER}, f AS (SELECT *, CASE WHEN user_id % 4 <> 0 THEN user_id END AS u, row_number() OVER (PARTITION BY "order", "index" ORDER BY "at", frame_id) AS n FROM frame_cells WHERE "order" >= 8
        AND NOT ("order" = 9 AND "index" IN (SELECT "index" FROM cell WHERE object_id % 6 = 0))) SELECT u AS user, sum("order" * 2)::BIGINT AS points, count(*) AS cells FROM f WHERE n = 1 AND u IS NOT NULL GROUP BY u""",
    "u7_rebuilt": f"WITH {S.FRAMES}, k AS (SELECT DISTINCT object_id FROM frames WHERE object_id % 7 = 0 AND NOT rejected) SELECT object_id, user_id, count(*) AS n FROM frames WHERE object_id NOT IN (SELECT object_id FROM k) OR NOT rejected GROUP BY ALL",
    "u8_counters": f"WITH {S.POSTS}, {S.LIKES}, m AS (SELECT post_id, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE -1 END) AS delta FROM likes WHERE user_id % 3 < 2 GROUP BY post_id) SELECT post_id, CAST(greatest(0, post_id % 4 + coalesce(delta, 0)) AS BIGINT) AS likes FROM posts LEFT JOIN m USING (post_id)",
    "a21_event_counts": f"""WITH {S.OBSERVATIONS}, o AS (SELECT date_trunc('hour', observed_at) AS event, observation_id % 5 = 0 AS moved FROM observations), n AS (SELECT event, count(*) AS n FROM o GROUP BY event), m AS (SELECT event, sum(delta) AS delta FROM (SELECT event + INTERVAL 1 HOUR AS event, 1 AS delta FROM o WHERE moved UNION ALL SELECT event, -1 FROM o WHERE moved) GROUP BY event)
        SELECT event, CAST(greatest(0, n + coalesce(delta, 0)) AS BIGINT) AS n FROM n LEFT JOIN m USING (event)""",
    "u9_two_current": f"WITH {S.JOBS} SELECT object_id, count(*) AS n FROM jobs WHERE job_type = 'stack' AND status NOT IN ('published', 'failed') GROUP BY object_id HAVING count(*) > 1",
    "u10_enqueued": f"WITH {S.OBSERVATIONS} SELECT 'cluster:' || observation_id AS key, 'cluster' AS job_type FROM observations WHERE status <> 'rejected' AND observation_id NOT IN (SELECT p_partkey * 3 FROM part)",
    "o05_replay": f"WITH {S.FRAMES} SELECT object_id AS layer, count(*) AS n, CASE WHEN object_id % 4 > 0 OR count(*) FILTER (WHERE line >= 7) = 0 THEN 'replay' ELSE 'build' END AS action FROM frames GROUP BY object_id",
}
