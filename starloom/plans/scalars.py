"""Queries that apply the small column functions and checks to whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from starloom.functions import astro as A
from starloom.functions import geo as G
from starloom.functions import healpix as H
from starloom.functions import misc as N
from starloom.functions import policy as P
from starloom.functions import text as X
from starloom.functions.maths import half_up
from starloom.operators import mosaic as M
from starloom.plans.astro import _MOON, _SUN, _TIMES
from starloom.plans.mosaic import _cell_sql
from starloom.sources import tables as S

AS_OF = dt.datetime(2024, 1, 20)


def _part(s, d):
    return S.table(s, d, "part").select("p_partkey", "p_size", "p_name", "p_brand")


def _rounded(df, digits, *columns):
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


def m25_stereographic(s, d):
    o = S.observations(s, d)
    x, y, z = G.stereographic(F.col("elevation"), F.col("azimuth"), 35.0, 120.0)
    return _rounded(o.select("observation_id", x.alias("x"), y.alias("y"), z.alias("z")).where("z >= -0.6"), 8, "x", "y", "z")


def p24_validation(s, d):
    o = S.observations(s, d)
    rules = [("latitude", F.col("latitude").between(43, 51)), ("longitude", F.col("longitude").between(0, 11)), ("azimuth", F.col("azimuth").between(0, 340)), ("elevation", F.col("elevation").between(12, 75)), ("value", F.col("value").isNotNull() & (F.col("value") > 1)), ("user", F.col("user_id").isNotNull())]
    return o.select("observation_id", F.array_join(F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in rules))), ",").alias("invalid"))


def p30_safe_paths(s, d):
    path = F.concat(F.lit("masters/"), F.when(F.col("p_size") % 5 == 0, "../").when(F.col("p_size") % 7 == 0, "/").otherwise(""), F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.lit("-"))), F.lit(".fits"))
    return _part(s, d).select("p_partkey", path.alias("path")).withColumn("safe", N.safe_path(F.col("path"), "masters/"))


def s23_surveys(s, d):
    """Each object's survey by its family, or the default one."""
    known = s.createDataFrame([("Brand#1", "dss"), ("Brand#2", "2mass"), ("Brand#3", "panstarrs")], "p_brand string, survey string")
    return _part(s, d).join(known, "p_brand", "left").select("p_partkey", F.coalesce("survey", F.lit("dss-color")).alias("survey"))


def x05_merged(s, d):
    left = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    right = F.when(F.col("p_size") > 25, F.create_map(F.lit("name"), F.upper("p_name"), F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("size"), F.lit("small")))
    entries = F.array_sort(F.transform(F.map_entries(N.merged(left, right)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return _part(s, d).select("p_partkey", F.array_join(entries, ";").alias("merged"))


def e25_queue_state(s, d):
    j = S.jobs(s, d)
    ended = F.col("status").isin("published", "rejected", "duplicate", "cancelled")
    spent = (F.col("status") == "failed") & (F.col("attempts") >= F.col("max_attempts"))
    return j.groupBy("object_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(ended).alias("ended"), F.count_if(spent).alias("exhausted"), F.bool_and(ended | spent).alias("settled"))


def h12_allsky_places(s, d):
    """Places in the all-sky image of the tiles that objects lie in, and how many do."""
    tiles = M.object_cells(S.objects(s, d), (3,)).groupBy(F.col("cell3").alias("index")).agg(F.count(F.lit(1)).alias("n_objects"))
    return tiles.select("index", (F.col("index") % 27).alias("column"), F.floor(F.col("index") / 27).alias("row"), "n_objects")


QUERIES = {
    "a22_bounding_box": lambda s, d: _rounded(S.observations(s, d).groupBy("phenomenon").agg((F.min("latitude") - 5).alias("south"), (F.max("latitude") + 5).alias("north"), (F.min("longitude") - 5).alias("west"), (F.max("longitude") + 5).alias("east")), 6, "south", "north", "west", "east"),
    "d06_mjd_times": lambda s, d: _part(s, d).select("p_partkey", N.from_mjd(50000 + F.col("p_partkey") + F.col("p_size") / 64).alias("at")),
    "d07_iso_text": lambda s, d: S.observations(s, d).select("observation_id", N.iso_text(F.col("observed_at")).alias("iso")),
    "d08_opacity": lambda s, d: _rounded(S.observations(s, d).select("observation_id", (F.unix_seconds(F.lit(AS_OF)) - F.unix_seconds(F.col("observed_at").cast("timestamp"))).alias("age")).where("age between 0 and 7200").withColumn("opacity", N.age_opacity(F.col("age"))), 9, "opacity"),
    "d09_delays": lambda s, d: S.jobs(s, d).select("job_id", N.retry_delay_s(F.col("attempts") * 2).alias("retry_s"), N.poll_delay_ms(F.col("status") != "published", F.col("attempts")).alias("poll_ms")),
    "e25_queue_state": e25_queue_state,
    "f08_topics": lambda s, d: S.table(s, d, "documents").select("doc_id", X.topic(F.col("text")).alias("topic")),
    "f19_names": lambda s, d: S.observations(s, d).select("observation_id", N.cardinal(F.col("azimuth")).alias("cardinal")),
    "f19_phase_names": lambda s, d: A.with_moon(A.with_sun(S.table(s, d, "orders").select(F.col("o_orderdate").alias("at")).distinct().withColumn("d", A.day_number(F.col("at"))))).select("at", A.phase_name(F.col("moon_phase")).alias("phase")),
    "h08_view_orders": lambda s, d: _part(s, d).select("p_partkey", H.order_for_width(F.col("p_size") * 1.5).alias("order")),
    "h12_allsky_places": h12_allsky_places,
    "m19_resolution": lambda s, d: _part(s, d).select("p_partkey", P.resolution_class(F.col("p_size") / 4 - 1).alias("class")),
    "m23_scales": lambda s, d: _rounded(_part(s, d).select("p_partkey", N.native_scale(F.col("p_size") / 10, F.col("p_partkey") % 900).alias("scale"), N.match_confidence(F.col("p_size"), F.col("p_partkey") % 30 / 10).alias("confidence")), 8, "scale", "confidence"),
    "m25_stereographic": m25_stereographic,
    "m26_ra_offset": lambda s, d: _rounded(S.objects(s, d).select("object_id", G.ra_offset(F.col("ra"), 350.0).alias("offset")), 8, "offset"),
    "m35_progress": lambda s, d: S.frames(s, d).groupBy("run_id").agg(N.percent(F.count_if(F.col("status") == "published"), F.count(F.lit(1))).alias("percent"), N.coverage_flag(F.avg(F.when(~F.col("rejected"), 1.0).otherwise(0.0)), F.count_distinct("object_id"), F.lit(3)).alias("partial")),
    "p24_validation": p24_validation,
    "p30_safe_paths": p30_safe_paths,
    "s23_surveys": s23_surveys,
    "x05_merged": x05_merged,
    "x10_safe_casts": lambda s, d: _part(s, d).select("p_partkey", F.substring_index("p_brand", "#", -1).try_cast("int").alias("number"), F.col("p_name").try_cast("double").alias("not_a_number"), F.nullif(F.trim("p_name"), F.lit("")).alias("name")),
    "x14_query_values": lambda s, d: S.table(s, d, "pages").select("page_id", N.query_value(F.col("url"), "page").try_cast("int").alias("page"), N.query_value(F.col("url"), "utm_source").alias("utm_source")),
}

_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"

ORACLES = {
    "a22_bounding_box": f"WITH {S.OBSERVATIONS} SELECT phenomenon, {_R('min(latitude) - 5', 6)} AS south, {_R('max(latitude) + 5', 6)} AS north, {_R('min(longitude) - 5', 6)} AS west, {_R('max(longitude) + 5', 6)} AS east FROM observations GROUP BY phenomenon",
    "d06_mjd_times": "SELECT p_partkey, make_timestamp(CAST(floor((50000 + p_partkey + p_size / 64 - 40587) * 86400000 + 0.5) AS BIGINT) * 1000) AS \"at\" FROM part",
    "d07_iso_text": "SELECT event_id AS observation_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events",
    "d08_opacity": f"WITH a AS (SELECT event_id AS observation_id, CAST(epoch(TIMESTAMP '2024-01-20') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM events) SELECT observation_id, age, {_R('greatest(0.2, 1 - age / 7200)', 9)} AS opacity FROM a WHERE age BETWEEN 0 AND 7200",
    "d09_delays": f"WITH {S.JOBS} SELECT job_id, CAST(least(900, pow(2, least(attempts * 2, 8))) AS BIGINT) AS retry_s, CAST(least(60000, CASE WHEN status <> 'published' THEN 5000 ELSE 30000 END * pow(2, least(attempts, 5))) AS BIGINT) AS poll_ms FROM jobs",
    "e25_queue_state": f"""WITH {S.JOBS}, f AS (SELECT object_id, status IN ('published', 'rejected', 'duplicate', 'cancelled') AS e, status = 'failed' AND attempts >= max_attempts AS x FROM jobs)
        SELECT object_id, count(*) AS jobs, count(*) FILTER (WHERE e) AS ended, count(*) FILTER (WHERE x) AS exhausted, bool_and(e OR x) AS settled FROM f GROUP BY object_id""",
    "f08_topics": f"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(translate(text, '{X.MARKED}', '{X.PLAIN}')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '\\b(moon|lune|luna|mond)\\b') THEN 'moon' WHEN regexp_matches(t, '\\b(sun|soleil|sol|sonne)\\b') THEN 'sun'
        WHEN regexp_matches(t, '\\b(star|etoile|estrella|stern)\\b') THEN 'star' ELSE 'other' END AS topic FROM t""",
    "f19_names": f"WITH {S.OBSERVATIONS} SELECT observation_id, {list(N.CARDINALS)}[CAST(floor(azimuth / 22.5 + 0.5) AS INT) % 16 + 1] AS cardinal FROM observations",
    "f19_phase_names": f"WITH {_TIMES}, {_SUN}, {_MOON} SELECT \"at\", ['new', 'waxing crescent', 'first quarter', 'waxing gibbous', 'full', 'waning gibbous', 'last quarter', 'waning crescent'][CAST(floor(moon_phase * 8 + 0.5) AS INT) % 8 + 1] AS phase FROM moon",
    "h08_view_orders": "SELECT p_partkey, CASE WHEN p_size * 1.5 <= 7.5 THEN 9 WHEN p_size * 1.5 <= 15 THEN 8 WHEN p_size * 1.5 <= 30 THEN 7 WHEN p_size * 1.5 <= 60 THEN 6 END AS \"order\" FROM part",
    "h12_allsky_places": f'WITH {S.OBJECTS}, {_cell_sql(3)} SELECT "index", "index" % 27 AS "column", "index" // 27 AS "row", count(*) AS n_objects FROM cell GROUP BY ALL',
    "m19_resolution": "SELECT p_partkey, CASE WHEN p_size / 4 - 1 <= 0 THEN NULL WHEN p_size / 4 - 1 <= 1.5 THEN 'high-definition' WHEN p_size / 4 - 1 <= 3 THEN 'detailed' WHEN p_size / 4 - 1 <= 6 THEN 'wide-field' WHEN p_size / 4 - 1 <= 12 THEN 'discovery' END AS class FROM part",
    "m23_scales": f"SELECT p_partkey, CASE WHEN p_partkey % 900 > 0 THEN {_R('206.265::DOUBLE * (p_size / 10) / (p_partkey % 900)', 8)} END AS scale, {_R('least(p_size / 40, 1) * greatest(0, 1 - (p_partkey % 30 / 10) / 2)', 8)} AS confidence FROM part",
    "m25_stereographic": f"""WITH {S.OBSERVATIONS}, a AS (SELECT observation_id, radians(elevation) AS h, radians(azimuth - 120) AS a, radians(35::DOUBLE) AS c FROM observations), z AS (SELECT *, sin(h) * sin(c) + cos(h) * cos(c) * cos(a) AS z FROM a)
        SELECT observation_id, {_R('2 / (1 + z) * cos(h) * sin(a)', 8)} AS x, {_R('2 / (1 + z) * (sin(h) * cos(c) - cos(h) * sin(c) * cos(a))', 8)} AS y, {_R('z', 8)} AS z FROM z WHERE z.z >= -0.6""",
    "m26_ra_offset": f"WITH {S.OBJECTS} SELECT object_id, {_R('fmod(fmod(ra - 350 + 180, 360::DOUBLE) + 360, 360::DOUBLE) - 180', 8)} AS \"offset\" FROM objects",
    "m35_progress": f"WITH {S.FRAMES} SELECT run_id, CAST(floor(count(*) FILTER (WHERE status = 'published') * 100 / count(*) + 0.5) AS INT) AS percent, avg((NOT rejected)::INT) < 0.995 OR count(DISTINCT object_id) < 3 AS partial FROM frames GROUP BY run_id",
    "p24_validation": f"""WITH {S.OBSERVATIONS} SELECT observation_id, concat_ws(',', CASE WHEN latitude NOT BETWEEN 43 AND 51 THEN 'latitude' END, CASE WHEN longitude NOT BETWEEN 0 AND 11 THEN 'longitude' END, CASE WHEN azimuth > 340 THEN 'azimuth' END,
        CASE WHEN elevation NOT BETWEEN 12 AND 75 THEN 'elevation' END, CASE WHEN value IS NULL OR value <= 1 THEN 'value' END, CASE WHEN user_id IS NULL THEN 'user' END) AS invalid FROM observations""",
    "p30_safe_paths": """WITH p AS (SELECT p_partkey, 'masters/' || CASE WHEN p_size % 5 = 0 THEN '../' WHEN p_size % 7 = 0 THEN '/' ELSE '' END || replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '-' END) || '.fits' AS path FROM part)
        SELECT p_partkey, path, regexp_full_match(path, '[A-Za-z0-9._/-]+') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS safe FROM p""",
    "s23_surveys": "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'dss' WHEN 'Brand#2' THEN '2mass' WHEN 'Brand#3' THEN 'panstarrs' ELSE 'dss-color' END AS survey FROM part",
    "x05_merged": "SELECT p_partkey, 'brand=' || p_brand || ';name=' || CASE WHEN p_size > 25 THEN upper(p_name) || ';size=' || p_size ELSE p_name || ';size=small' END AS merged FROM part",
    "x10_safe_casts": "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INT) AS number, CAST(NULL AS DOUBLE) AS not_a_number, nullif(trim(p_name), '') AS name FROM part",
    "x14_query_values": r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages",
}
