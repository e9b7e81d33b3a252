"""Rollup queries."""

from __future__ import annotations

from starloom.operators import rollups as R
from starloom.sources import tables as S

ELIGIBLE = "status IN ('approved', 'published', 'stacked') AND NOT rejected"
STATS = f"""stats AS (SELECT object_id, count(*) FILTER (WHERE kind = 'light') AS n_light, count(*) FILTER (WHERE kind = 'dark') AS n_dark, count(*) FILTER (WHERE kind = 'flat') AS n_flat,
 count(*) FILTER (WHERE kind = 'bias') AS n_bias, count(DISTINCT user_id) AS contributors, coalesce(sum(exposure_s) FILTER (WHERE kind = 'light'), 0.0::DOUBLE) / 3600 AS exposure_hours
 FROM frames WHERE {ELIGIBLE} GROUP BY object_id)"""

QUERIES = {
    "q07_object_stats": lambda s, d: R.object_stats(S.frames(s, d)),
    "q07_contributions": lambda s, d: R.contributions(S.frames(s, d)),
    "q05_top_contributors": lambda s, d: R.top_contributors(S.frames(s, d), 3),
    "q06_recommendations": lambda s, d: R.recommendations(S.frames(s, d), S.objects(s, d), 7, 20),
    "a05_qualification": lambda s, d: R.qualification(S.frames(s, d)),
    "a06_ordered_frames": lambda s, d: R.ordered_frames(S.frames(s, d)),
    "a07_inventory_hash": lambda s, d: R.inventory_hashes(S.frames(s, d)),
    "a10_status_map": lambda s, d: R.status_map(S.frames(s, d)),
    "a08_distinct_kinds": lambda s, d: R.distinct_kinds(S.frames(s, d)),
    "a19_totals": lambda s, d: R.totals(R.object_stats(S.frames(s, d))),
    "a40_calibration_completeness": lambda s, d: R.calibration_completeness(R.object_stats(S.frames(s, d))),
    "w05_first_of_each": lambda s, d: R.first_of_each(S.frames(s, d), "object_id"),
    "w10_exposure_budget": lambda s, d: R.within_budget(S.frames(s, d), 80.0),
    "j23_duplicates": lambda s, d: R.duplicates(S.frames(s, d)),
}

ORACLES = {
    "q07_object_stats": f"WITH {S.FRAMES}, {STATS} SELECT * FROM stats",
    "q07_contributions": f"""WITH {S.FRAMES} SELECT user_id, object_id, count(*) AS n_frames, sum(exposure_s) AS exposure_s, avg(quality) AS quality, min(uploaded_at) AS first_at, max(uploaded_at) AS last_at
        FROM frames WHERE {ELIGIBLE} AND user_id IS NOT NULL GROUP BY user_id, object_id""",
    "q05_top_contributors": f"""WITH {S.FRAMES}, c AS (SELECT object_id, user_id, sum(exposure_s) AS exposure_s, count(*) AS n_frames FROM frames WHERE {ELIGIBLE} GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY object_id ORDER BY exposure_s DESC, user_id) AS INT) AS place FROM c) SELECT object_id, place, user_id, exposure_s, n_frames FROM r WHERE place <= 3""",
    "q06_recommendations": f"""WITH {S.FRAMES}, {S.OBJECTS}, {STATS} SELECT s.object_id, o.name, n_light / greatest(contributors, 1) + CASE WHEN n_dark < 50 THEN 50 ELSE 0 END + CASE WHEN n_flat < 50 THEN 30 ELSE 0 END AS need
        FROM stats s JOIN objects o USING (object_id) WHERE NOT EXISTS (SELECT 1 FROM frames f WHERE f.user_id = 7 AND f.object_id = s.object_id) ORDER BY need DESC, s.object_id LIMIT 20""",
    "a05_qualification": f"""WITH {S.FRAMES} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE {ELIGIBLE}) AS accepted, count(*) FILTER (WHERE rejected) AS rejected_frames,
        count(*) FILTER (WHERE status = 'approved' AND NOT rejected) AS active, max(uploaded_at) AS last_at FROM frames GROUP BY run_id""",
    "a06_ordered_frames": f"""WITH {S.FRAMES} SELECT object_id, coalesce(string_agg(frame_id, ',' ORDER BY quality DESC, uploaded_at, frame_id) FILTER (WHERE kind = 'light'), '') AS lights,
        coalesce(string_agg(frame_id, ',' ORDER BY quality DESC, uploaded_at, frame_id) FILTER (WHERE kind = 'dark'), '') AS darks FROM frames WHERE {ELIGIBLE} GROUP BY object_id""",
    "a07_inventory_hash": f"WITH {S.FRAMES} SELECT object_id, count(*) AS n_frames, sha256(string_agg(frame_id, chr(10) ORDER BY frame_id)) AS sha256 FROM frames WHERE {ELIGIBLE} GROUP BY object_id",
    "a10_status_map": f"""WITH {S.FRAMES}, c AS (SELECT run_id, status, count(*) AS n FROM frames GROUP BY ALL)
        SELECT run_id, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY run_id""",
    "a08_distinct_kinds": f"WITH {S.FRAMES} SELECT run_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT (object_id, user_id)) AS pairs FROM frames GROUP BY run_id",
    "a19_totals": f"""WITH {S.FRAMES}, {STATS} SELECT CAST(sum(n_light) AS BIGINT) AS lights, CAST(sum(contributors) AS BIGINT) AS contributors, floor(sum(exposure_hours) * 1e6 + 0.5) / 1e6 AS hours,
        count(*) FILTER (WHERE n_light >= 3) AS stackable FROM stats""",
    "a40_calibration_completeness": f"""WITH {S.FRAMES}, {STATS} SELECT object_id, ((n_light >= 5)::INT::DOUBLE + (n_dark >= 3)::INT + (n_flat >= 2)::INT + (n_bias >= 1)::INT) / 4 AS completeness FROM stats""",
    "w05_first_of_each": f"WITH {S.FRAMES} SELECT DISTINCT ON (object_id) object_id, frame_id, uploaded_at, user_id FROM frames ORDER BY object_id, uploaded_at, frame_id",
    "w10_exposure_budget": f"""WITH {S.FRAMES}, b AS (SELECT *, coalesce(sum(exposure_s) OVER (PARTITION BY run_id ORDER BY quality DESC, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS spent_s FROM frames)
        SELECT run_id, frame_id, exposure_s, spent_s FROM b WHERE spent_s + exposure_s <= 80""",
    "j23_duplicates": f"""WITH {S.FRAMES}, m AS (SELECT frame_id, first_value(frame_id) OVER (PARTITION BY object_id, user_id, exposure_s ORDER BY uploaded_at, frame_id) AS original FROM frames)
        SELECT frame_id, original FROM m WHERE original <> frame_id""",
}
