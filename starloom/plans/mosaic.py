"""Sky-cell queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.maths import steady
from starloom.operators import mosaic as M
from starloom.sources import tables as S
from starloom.sources.storage import written


def _cells(s, d):
    return M.frame_cells(S.frames(s, d), S.objects(s, d))


def _top(s, d):
    return M.object_cells(S.objects(s, d), (9,)).select(F.lit(9).alias("order"), F.col("cell9").alias("index"))


def _damaged(s, d):
    """The closed pyramid without every 23rd cell, with a cell that isn't planned for every 31st."""
    return _damage(M.pyramid(_top(s, d), 6))


def _damage(whole):
    kept = whole.where((F.col("index") * 4 + F.col("order")) % 23 != 0)
    extra = whole.where((F.col("index") + F.col("order")) % 31 == 0).select("order", (F.col("index") + 1).alias("index"))
    return kept.unionByName(extra)


def q22_violations(s, d):
    """Several rules read both sets of cells, so each is made once."""
    whole = written(M.pyramid(_top(s, d), 6), "pyramid")
    return M.violations(whole, written(_damage(whole), "damaged"), 6, 9)


def h02_cell_centres(s, d):
    cells = H.with_centre(M.object_cells(S.objects(s, d), (8,)), "cell8", 8)
    return cells.select("object_id", "cell8", *(steady(F.col(c), 8).alias(c) for c in ("centre_ra", "centre_dec")))


def h05_ancestors(s, d):
    c = M.object_cells(S.objects(s, d), (9,))
    i = F.col("cell9")
    return c.select("object_id", i.alias("cell9"), H.parent(i).alias("parent"), H.parent(i, 3).alias("ancestor6"), F.element_at(H.children(i), 1).alias("first_child"), F.element_at(H.children(i), -1).alias("last_child"))


def f12_tile_paths(s, d):
    c = M.object_cells(S.objects(s, d), (9,)).select("object_id", F.when(F.col("object_id") % 5 == 0, F.col("cell9") * 100).otherwise(F.col("cell9")).alias("index"))
    paths = c.withColumn("path", H.tile_path("sky-r", 3, F.lit(9), F.col("index")))
    return paths.withColumn("p", H.parsed_path(F.col("path"))).select("object_id", "path", F.col("p.order").alias("order"), F.col("p.index").alias("index"))


def q08_requested_cells(s, d):
    asked = M.object_cells(S.objects(s, d), (8,)).select(F.lit(8).alias("order"), F.col("cell8").alias("index")).distinct()
    more = asked.select("order", (F.col("index") + 5).alias("index"))
    return M.covered(asked.unionByName(more).distinct(), M.best_tiles(M.tiles(S.frames(s, d), S.objects(s, d))))


def _rounded(df, column):
    return df.withColumn(column, F.floor(F.col(column) * 1e9 + 0.5) / 1e9)


QUERIES = {
    "h01_object_cells": lambda s, d: M.object_cells(S.objects(s, d)),
    "h02_cell_centres": h02_cell_centres,
    "h05_ancestors": h05_ancestors,
    "h10_pyramid": lambda s, d: M.pyramid(_top(s, d), 6),
    "a37_counts_by_order": lambda s, d: M.counts_by_order(M.pyramid(_top(s, d), 3)),
    "h11_orphans": lambda s, d: M.orphans(_damaged(s, d), 6, 9),
    "u01_symmetric_difference": lambda s, d: M.symmetric_difference(M.pyramid(_top(s, d), 6), _damaged(s, d), ["order", "index"]),
    "q22_violations": q22_violations,
    "q23_plan_hash": lambda s, d: M.plan_hash(M.pyramid(_top(s, d), 6)),
    "q14_claims": lambda s, d: M.claims(M.frame_cells(M.first_frames(S.frames(s, d)), S.objects(s, d))),
    "q13_best_tiles": lambda s, d: M.best_tiles(M.tiles(S.frames(s, d), S.objects(s, d))),
    "q08_requested_cells": q08_requested_cells,
    "a25_attribution": lambda s, d: _rounded(M.attribution(_cells(s, d).where(F.col("order") == 9)), "share"),
    "a26_ancestor_shares": lambda s, d: _rounded(M.to_ancestors(M.attribution(_cells(s, d).where(F.col("order") == 9)), 6), "share"),
    "f12_tile_paths": f12_tile_paths,
}


def _cell_sql(order: int) -> str:
    """CTEs up to cell(object_id, index) at an order, from objects."""
    ns = 1 << order
    bits = " + ".join(f"(((ix >> {b}) & 1) << {2 * b}) + (((iy >> {b}) & 1) << {2 * b + 1})" for b in range(order))
    return f"""ang AS (SELECT object_id, sin(radians("dec")) AS z, fmod(radians(ra), 2 * pi()) / (pi() / 2) AS t FROM objects),
 arms AS (SELECT object_id, z, t, CAST(floor({ns} * (0.5::DOUBLE + t) - {ns} * z * 0.75::DOUBLE) AS BIGINT) AS jp, CAST(floor({ns} * (0.5::DOUBLE + t) + {ns} * z * 0.75::DOUBLE) AS BIGINT) AS jm, least(3, CAST(floor(t) AS BIGINT)) AS q FROM ang),
 caps AS (SELECT *, least({ns - 1}, CAST(floor((t - q) * ({ns} * sqrt(3 * (1 - abs(z))))) AS BIGINT)) AS p, least({ns - 1}, CAST(floor((1 - (t - q)) * ({ns} * sqrt(3 * (1 - abs(z))))) AS BIGINT)) AS m FROM arms),
 xy AS (SELECT object_id, CASE WHEN abs(z) <= 2::DOUBLE / 3 THEN CASE WHEN (jp >> {order}) = (jm >> {order}) THEN (jp >> {order}) | 4 WHEN (jp >> {order}) < (jm >> {order}) THEN jp >> {order} ELSE (jm >> {order}) + 8 END WHEN z >= 0 THEN q ELSE q + 8 END AS face,
 CASE WHEN abs(z) <= 2::DOUBLE / 3 THEN jm & {ns - 1} WHEN z >= 0 THEN {ns - 1} - m ELSE p END AS ix, CASE WHEN abs(z) <= 2::DOUBLE / 3 THEN {ns - 1} - (jp & {ns - 1}) WHEN z >= 0 THEN {ns - 1} - p ELSE m END AS iy FROM caps),
 cell AS (SELECT object_id, face * {ns * ns} + {bits} AS "index" FROM xy)"""


_BASE = f"{S.OBJECTS}, {_cell_sql(9)}"
_PYRAMID = lambda low: f"""pyramid AS (SELECT DISTINCT CAST(o AS INT) AS "order", "index" >> CAST(2 * (9 - o) AS BIGINT) AS "index" FROM (SELECT DISTINCT "index" FROM cell), range({low}, 10) r(o))"""
_DAMAGED = """damaged AS (SELECT * FROM pyramid WHERE ("index" * 4 + "order") % 23 <> 0 UNION ALL SELECT "order", "index" + 1 FROM pyramid WHERE ("index" + "order") % 31 = 0)"""
_ORPHANS = """orphans AS (SELECT "order", "index", 'no-parent' AS problem FROM damaged c WHERE "order" > 6 AND NOT EXISTS (SELECT 1 FROM damaged p WHERE p."order" = c."order" - 1 AND p."index" = c."index" >> 2)
 UNION ALL SELECT "order", "index", 'no-child' FROM damaged c WHERE "order" < 9 AND NOT EXISTS (SELECT 1 FROM damaged p WHERE p."order" = c."order" + 1 AND p."index" >> 2 = c."index"))"""
_DIFFERENCE = """difference AS ((SELECT "order", "index", 'missing' AS side FROM (SELECT "order", "index" FROM pyramid EXCEPT SELECT "order", "index" FROM damaged)) UNION ALL
 (SELECT "order", "index", 'unexpected' FROM (SELECT "order", "index" FROM damaged EXCEPT SELECT "order", "index" FROM pyramid)))"""
_COVER = f"""frame_cells AS (SELECT frame_id, user_id, f.object_id, CAST(o AS INT) AS "order", "index" >> CAST(2 * (9 - o) AS BIGINT) AS "index", quality / 100 AS coverage, uploaded_at AS "at"
 FROM frames f JOIN cell USING (object_id), range(6, 10) r(o) WHERE status IN ('approved', 'published', 'stacked') AND NOT rejected)"""
_TILES = """tiles AS (SELECT "order", "index", object_id, count(*) AS n_sources, count(DISTINCT user_id) AS n_users, max("at") AS activated_at, min(coverage) AS scale, ['r', 'g', 'rgb'][object_id % 3 + 1] AS band,
 'sky-' || ['r', 'g', 'rgb'][object_id % 3 + 1] || CASE WHEN object_id % 50 = 0 THEN '-global' ELSE '' END AS slug FROM frame_cells WHERE "order" >= 8 GROUP BY "order", "index", object_id),
 best AS (SELECT *, row_number() OVER (PARTITION BY "order", "index" ORDER BY CASE WHEN regexp_matches(slug, '^sky-(r|g|rgb)-global$') THEN 0 ELSE 1 END, CASE band WHEN 'rgb' THEN 0 WHEN 'r' THEN 1 ELSE 2 END,
 scale ASC NULLS LAST, n_sources DESC, n_users DESC NULLS LAST, activated_at DESC, slug, object_id) AS n FROM tiles),
 best_tiles AS (SELECT "order", "index", object_id, slug, scale, n_sources, format('hips/best/1/Norder{}/Dir{}/Npix{}.webp', "order", "index" // 10000 * 10000, "index") AS path FROM best WHERE n = 1)"""
_SHARES = """w AS (SELECT "order", "index", user_id, sum(greatest(coverage, 0)) AS w FROM frame_cells WHERE "order" = 9 GROUP BY ALL),
 shares AS (SELECT "order", "index", user_id, CASE WHEN sum(w) OVER c > 0 THEN w / sum(w) OVER c ELSE 1 / count(*) OVER c END AS share FROM w WINDOW c AS (PARTITION BY "order", "index"))"""

ORACLES = {
    "h01_object_cells": f'WITH {_BASE} SELECT object_id, "index" >> 6 AS cell6, "index" >> 4 AS cell7, "index" >> 2 AS cell8, "index" AS cell9 FROM cell',
    "h05_ancestors": f'WITH {_BASE} SELECT object_id, "index" AS cell9, "index" // 4 AS parent, "index" // 64 AS ancestor6, "index" * 4 AS first_child, "index" * 4 + 3 AS last_child FROM cell',
    "h10_pyramid": f"WITH {_BASE}, {_PYRAMID(6)} SELECT * FROM pyramid",
    "a37_counts_by_order": f'WITH {_BASE}, {_PYRAMID(3)} SELECT "order", count(*) AS n_cells, min("index") AS first_index, max("index") AS last_index FROM pyramid GROUP BY "order"',
    "h11_orphans": f"WITH {_BASE}, {_PYRAMID(6)}, {_DAMAGED}, {_ORPHANS} SELECT * FROM orphans",
    "u01_symmetric_difference": f"WITH {_BASE}, {_PYRAMID(6)}, {_DAMAGED}, {_DIFFERENCE} SELECT * FROM difference",
    "q22_violations": f"""WITH {_BASE}, {_PYRAMID(6)}, {_DAMAGED}, {_ORPHANS}, {_DIFFERENCE}, broken AS (SELECT problem FROM orphans UNION ALL SELECT 'tile-' || side FROM difference
        UNION ALL SELECT 'invalid-index' FROM damaged WHERE "index" < 0 OR "index" >= 12 * pow(4, "order") UNION ALL SELECT 'duplicate-tile' FROM damaged GROUP BY "order", "index" HAVING count(*) > 1) SELECT problem, count(*) AS n FROM broken GROUP BY problem""",
    "q23_plan_hash": f"""WITH {_BASE}, {_PYRAMID(6)} SELECT "index" % 7 AS part, count(*) AS n, sha256('[' || string_agg('{{"index": ' || "index" || ', "order": ' || "order" || '}}', ', ' ORDER BY "order", "index") || ']') AS sha256 FROM pyramid GROUP BY 1""",
    "q14_claims": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "order", "index" ORDER BY "at", frame_id) AS n FROM frame_cells WHERE coverage * 100 >= 5) WHERE n = 1),
        pts AS (SELECT *, CASE "order" WHEN 6 THEN 2 WHEN 7 THEN 5 WHEN 8 THEN 10 ELSE 20 END AS points FROM won), run AS (SELECT *, CAST(sum(points) OVER (PARTITION BY frame_id ORDER BY "order" DESC, "index") AS BIGINT) AS running FROM pts)
        SELECT frame_id, user_id, "order", "index", points, running, concat_ws(':', 'coverage', frame_id, "order", "index") AS key FROM run WHERE running <= 500""",
    "q13_best_tiles": f"WITH {S.FRAMES}, {_BASE}, {_COVER}, {_TILES} SELECT * FROM best_tiles",
    "q08_requested_cells": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, {_TILES}, asked AS (SELECT DISTINCT "index" >> 2 AS "index" FROM cell), wanted AS (SELECT "index" FROM asked UNION SELECT "index" + 5 FROM asked)
        SELECT 8 AS "order", w."index", coalesce(slug, 'uncovered') AS slug, coalesce(path, '') AS path FROM wanted w LEFT JOIN best_tiles b ON b."order" = 8 AND b."index" = w."index" """,
    "a25_attribution": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, {_SHARES} SELECT "order", "index", user_id, floor(share * 1e9 + 0.5) / 1e9 AS share FROM shares""",
    "a26_ancestor_shares": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, {_SHARES}, s AS (SELECT "index" >> 6 AS "index", user_id, sum(share) AS s FROM shares GROUP BY ALL)
        SELECT 6 AS "order", "index", user_id, floor(s / sum(s) OVER (PARTITION BY "index") * 1e9 + 0.5) / 1e9 AS share FROM s""",
    "f12_tile_paths": f"""WITH {_BASE}, i AS (SELECT object_id, CASE WHEN object_id % 5 = 0 THEN "index" * 100 ELSE "index" END AS "index" FROM cell),
        p AS (SELECT object_id, format('hips/sky-r/3/Norder9/Dir{{}}/Npix{{}}.webp', "index" // 10000 * 10000, "index") AS path, "index" FROM i)
        SELECT object_id, path, CASE WHEN "index" < 12 * pow(4, 9) THEN 9::BIGINT END AS "order", CASE WHEN "index" < 12 * pow(4, 9) THEN "index" END AS "index" FROM p""",
}
