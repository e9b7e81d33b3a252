"""Policy and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import policy as P
from starloom.functions import text as X
from starloom.sources import tables as S

TERMS = ("the in", "NGC 12", "que", "der")


def metrics(s, d):
    """Quality metrics of each frame, derived from its numbers."""
    k, n = F.col("run_id") + F.col("object_id"), F.col("user_id") + F.col("line")
    return S.frames(s, d).select(
        "frame_id",
        (k % 100).cast("int").alias("matched_stars"),
        ((n % 40) / 20.0).alias("wcs_rms_px"),
        (0.6 + (k % 41) / 100.0).alias("usable_coverage"),
        F.when(k % 37 != 0, 1.0 + (n % 30) / 10.0).alias("fwhm_arcsec"),
        (0.5 + (k % 27) / 2.0).alias("pixel_scale_arcsec"),
        (0.5 + ((k + n) % 27) / 2.0).alias("native_pixel_scale_arcsec"),
        ((n % 80) / 100.0).alias("eccentricity"),
        ((k % 25) / 1000.0).alias("saturated_fraction"),
        ((n % 12) / 1000.0).alias("clipped_black_fraction"),
        (2.0 + k % 30).alias("signal_to_noise"),
        (k % 2 == 0).alias("metadata_complete"),
        F.when(n % 23 != 0, n % 19 != 0).alias("licence_accepted"),
        F.when(k % 7 != 0, k % 3 == 0).alias("trusted_astrometry"),
        (n % 5 == 0).alias("calibrated_science_product"),
        (k % 29 == 0).alias("has_major_tracking_error"),
        (n % 31 == 0).alias("has_dense_clouds"),
        F.lit(None).cast("boolean").alias("duplicate_detected"),
    )


def _docs(s, d):
    return S.table(s, d, "documents").select("doc_id", "text")


QUERIES = {
    "m21_quality_policy": lambda s, d: P.qualified(metrics(s, d)).select("frame_id", "resolution_class", "blockers", "score", "eligible"),
    "f01_normalise": lambda s, d: _docs(s, d).select("doc_id", F.sha2(X.normalise(F.col("text")), 256).alias("sha256"), F.length(X.normalise(F.col("text"))).cast("bigint").alias("n_chars")),
    "f03_relevance": lambda s, d: _docs(s, d).select("doc_id", X.is_relevant(F.col("text"), F.lit(""), TERMS).alias("relevant")),
    "f04_strip_html": lambda s, d: S.table(s, d, "pages").select("page_id", F.sha2(X.strip_html(F.col("html")), 256).alias("sha256")),
    "f05_slug": lambda s, d: S.table(s, d, "part").select("p_partkey", X.slug(F.concat_ws("  ", "p_name", "p_brand")).alias("slug"), X.safe_name(F.concat_ws(" / ", "p_name", "p_brand")).alias("file")),
    "f07_aliases": lambda s, d: S.table(s, d, "part").select("p_partkey", F.array_join(X.aliases(F.concat(F.lit("NGC "), F.col("p_partkey").cast("string"), F.lit("/"), (F.col("p_partkey") + F.col("p_size") % 2).cast("string"))), ",").alias("aliases")),
    "f15_properties": lambda s, d: S.table(s, d, "part").select(
        "p_partkey", X.properties(F.concat(F.lit("# note = x\nname = "), F.col("p_name"), F.lit("\nno line\nbrand="), F.col("p_brand"))).alias("m")
    ).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"), F.map_contains_key("m", "# note").alias("has_comment")),
    "p12_json_keys": lambda s, d: S.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z")),
}

_METRICS = f"""{S.FRAMES}, kn AS (SELECT frame_id, run_id + object_id AS k, user_id + line AS n FROM frames),
 m AS (SELECT frame_id, k % 100 AS stars, (n % 40) / 20.0::DOUBLE AS rms, 0.6::DOUBLE + (k % 41) / 100.0::DOUBLE AS cov, CASE WHEN k % 37 <> 0 THEN 1.0::DOUBLE + (n % 30) / 10.0::DOUBLE END AS fwhm, 0.5::DOUBLE + (k % 27) / 2.0::DOUBLE AS scale,
 0.5::DOUBLE + ((k + n) % 27) / 2.0::DOUBLE AS native, (n % 80) / 100.0::DOUBLE AS ecc, (k % 25) / 1000.0::DOUBLE AS sat, (n % 12) / 1000.0::DOUBLE AS clip, 2.0::DOUBLE + k % 30 AS snr, k % 2 = 0 AS meta, coalesce(CASE WHEN n % 23 <> 0 THEN n % 19 <> 0 END, false) AS lic,
 coalesce(CASE WHEN k % 7 <> 0 THEN k % 3 = 0 END, false) AS trusted, n % 5 = 0 AS product, k % 29 = 0 AS tracking, n % 31 = 0 AS clouds FROM kn)"""
_CL = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
_R2 = lambda x: f"round_even(coalesce({x}, 0) * 100, 0) / 100"
_NORMAL = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"

ORACLES = {
    "m21_quality_policy": f"""WITH {_METRICS}, r AS (SELECT frame_id, CASE WHEN greatest(scale, native) <= 0 THEN NULL WHEN greatest(scale, native) <= 1.5 THEN 'high-definition' WHEN greatest(scale, native) <= 3 THEN 'detailed'
        WHEN greatest(scale, native) <= 6 THEN 'wide-field' WHEN greatest(scale, native) <= 12 THEN 'discovery' END AS resolution_class, *  EXCLUDE (frame_id) FROM m),
        b AS (SELECT *, concat_ws(',', CASE WHEN NOT trusted AND stars < 20 THEN 'insufficient-reference-stars' END, CASE WHEN NOT trusted AND rms >= 1.5 THEN 'wcs-error-too-high' END, CASE WHEN cov < 0.7::DOUBLE THEN 'insufficient-coverage' END,
        CASE WHEN fwhm >= CASE WHEN product THEN 6.0::DOUBLE ELSE 2.5::DOUBLE END * scale THEN 'poor-fwhm' END, CASE WHEN ecc >= 0.65::DOUBLE THEN 'excessive-eccentricity' END, CASE WHEN tracking THEN 'major-tracking-error' END,
        CASE WHEN clouds THEN 'dense-clouds' END, CASE WHEN sat >= 0.02::DOUBLE THEN 'excessive-saturation' END, CASE WHEN clip >= 0.01::DOUBLE THEN 'black-clipping' END, CASE WHEN snr < 5 THEN 'insufficient-signal' END,
        CASE WHEN scale < native * 0.75::DOUBLE THEN 'artificial-upscale' END, CASE WHEN NOT lic THEN 'missing-licence' END, CASE WHEN resolution_class IS NULL THEN 'unsupported-resolution' END) AS blockers,
        {_R2(f"CASE WHEN trusted THEN 25.0::DOUBLE ELSE {_CL('(stars - 20) / 60')} * 10 + {_CL('(1.5::DOUBLE - rms) / 1.5::DOUBLE')} * 15 END")} + {_R2(f"{_CL('(2.5::DOUBLE - fwhm / scale) / 2')} * 14 + {_CL('(0.65::DOUBLE - ecc) / 0.45::DOUBLE')} * 11")}
        + {_R2(f"{_CL('(snr - 5) / 20')} * 20")} + {_R2(f"{_CL('(0.02::DOUBLE - sat) / 0.02::DOUBLE')} * 8 + {_CL('(0.01::DOUBLE - clip) / 0.01::DOUBLE')} * 7")} + {_R2(f"{_CL('(cov - 0.7::DOUBLE) / 0.3::DOUBLE')} * 10")} + CASE WHEN meta THEN 5 ELSE 2 END AS parts FROM r),
        s AS (SELECT *, CAST(round_even(floor(parts * 10000 + 0.5) / 10000, 0) AS INT) AS score FROM b) SELECT frame_id, resolution_class, blockers, score, score >= 70 AND blockers = '' AS eligible FROM s""",
    "f01_normalise": f"SELECT doc_id, sha256({_NORMAL('text')}) AS sha256, length({_NORMAL('text')}) AS n_chars FROM documents",
    "f03_relevance": f"""WITH h AS (SELECT doc_id, {_NORMAL("text")} AS hay FROM documents) SELECT doc_id, NOT ({" OR ".join(f"contains(hay, '{t}')" for t in X.BLOCKED)})
        AND (contains(' ' || hay || ' ', ' the in ') OR contains(replace(hay, ' ', ''), 'ngc12') OR contains(' ' || hay || ' ', ' que ') OR contains(' ' || hay || ' ', ' der ')) AS relevant FROM h""",
    "f04_strip_html": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS sha256 FROM pages",
    "f05_slug": f"SELECT p_partkey, replace({_NORMAL('concat_ws(chr(32) || chr(32), p_name, p_brand)')}, ' ', '-') AS slug, right(regexp_replace(concat_ws(' / ', p_name, p_brand), '[^a-zA-Z0-9._-]+', '-', 'g'), 180) AS file FROM part",
    "f07_aliases": "SELECT p_partkey, 'NGC ' || p_partkey || CASE WHEN p_size % 2 = 1 THEN ',NGC ' || (p_partkey + 1) ELSE '' END AS aliases FROM part",
    "f15_properties": "SELECT p_partkey, trim(p_name) AS name, trim(p_brand) AS brand, false AS has_comment FROM part",
    "p12_json_keys": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.z') IS NOT NULL AS has_z FROM events",
}
