"""Rules for uploads, paths, addresses and archive products, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import contracts as C
from starloom.sources import tables as S

HOSTS = ("www.example.com", "example.org", "data.example.net")


def _pick(key, *values):
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def p21_live_uploads(s, d):
    return S.uploads(s, d).where(F.col("deleted_at").isNull()).select("upload_id", "object_id")


def p25_upload_metadata(s, d):
    return S.uploads(s, d).select("upload_id", C.broken(C.upload_rules()).alias("invalid"))


def p26_acceptable_files(s, d):
    return S.uploads(s, d).select("upload_id", C.extension(F.col("filename")).alias("extension"), C.acceptable_file(F.col("filename"), F.col("size_bytes")).alias("accepted"))


def p27_vision_gate(s, d):
    docs = S.table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("toxic") == 1).alias("generated"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 100 / 100.0).alias("confidence"))
    return docs.where(C.passes_vision(F.col("generated"), F.col("confidence")))


def p28_owner_conflicts(s, d):
    return S.uploads(s, d).where(~C.owner_agrees(F.col("source_kind"), F.col("user_id"), F.col("archive_item_id"))).select("upload_id", "source_kind", "user_id", "archive_item_id")


def p29_runs_without_target(s, d):
    k = F.col("o_orderkey")
    query = F.when(k % 3 == 0, F.concat(F.lit('{"seed_order": 4, "seed_index": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, '{"seed_order": 4}')
    runs = S.table(s, d, "orders").select(k.alias("run_id"), F.when(k % 4 == 0, F.concat(F.lit("M"), k.cast("string"))).alias("object_id"), query.alias("query"))
    return runs.where(~C.has_target(F.col("object_id"), F.col("query"))).select("run_id")


def p31_master_paths(s, d):
    k = F.col("p_partkey")
    path = F.concat(_pick(k, "masters/", "masters/", "hips/"), _pick(F.floor(k / 3), "m31", "M31", "m31-r", "m31-r", "m3", ""), F.lit("/"), (F.floor(k / 18) % 4).cast("string"), F.when(k % 5 > 0, F.concat(F.lit("/"), k.cast("string"), F.lit(".fits"))).otherwise(""))
    rows = S.table(s, d, "part").select("p_partkey", path.alias("path"))
    return rows.withColumn("fits", C.master_path_fits(F.col("path"), F.lit("M31"), F.lit(2)))


def p32_trusted_archives(s, d):
    k = F.col("upload_id")
    u = S.uploads(s, d).select(k, "source_kind", "archive_item_id", _pick(k, "mast-ps1", None, "eso").alias("own_source"), _pick(F.floor(k / 9), None, "mast-ps1").alias("archive_source"), F.when(k % 2 == 0, F.upper(F.col("content_sha256"))).alias("own_record"), F.when(k % 5 == 0, "12ab").alias("archive_record"), _pick(F.floor(k / 18), "stack-cutout", "stack-cutout", "warp", None).alias("product"))
    trusted = C.trusted_archive(F.col("source_kind"), F.col("archive_item_id"), [F.col("own_source"), F.col("archive_source")], [F.col("own_record"), F.col("archive_record")], F.col("product"))
    return u.where(trusted).select("upload_id")


def p33_allowed_urls(s, d):
    return S.table(s, d, "pages").select("page_id", C.allowed_url(F.col("url"), HOSTS).alias("allowed"))


def _products(s, d):
    k = F.col("c_custkey")
    return S.table(s, d, "customer").select(
        k.alias("product_id"),
        (k % 40).alias("obs_id"),
        F.concat(F.lit("file"), k.cast("string"), _pick(k, ".fits", ".FITS.FZ", ".jpg", ".fz")).alias("filename"),
        _pick(F.floor(k / 2), "SCIENCE", "science", "AUXILIARY", None).alias("product_type"),
        _pick(F.floor(k / 3), "DRC", "FLT", "drz", "RAW", None).alias("subgroup"),
        _pick(F.floor(k / 5), 3, 1, 2, None).cast("int").alias("calibration"),
        _pick(F.floor(k / 7), "HST", "DSS plates", "HLA").alias("collection"),
        _pick(F.floor(k / 11), "PUBLIC", "Exclusive access", " public ", None, "open", "publicly released").alias("rights"),
        _pick(F.floor(k / 13), "mast", "eso", "irsa", "noirlab").alias("provider"),
    )


_PRODUCTS = """products AS (SELECT c_custkey AS product_id, c_custkey % 40 AS obs_id, 'file' || c_custkey || (['.fits', '.FITS.FZ', '.jpg', '.fz'])[c_custkey % 4 + 1] AS filename, (['SCIENCE', 'science', 'AUXILIARY', NULL])[c_custkey // 2 % 4 + 1] AS product_type,
 (['DRC', 'FLT', 'drz', 'RAW', NULL])[c_custkey // 3 % 5 + 1] AS subgroup, ([3, 1, 2, NULL])[c_custkey // 5 % 4 + 1]::INT AS calibration, (['HST', 'DSS plates', 'HLA'])[c_custkey // 7 % 3 + 1] AS collection,
 (['PUBLIC', 'Exclusive access', ' public ', NULL, 'open', 'publicly released'])[c_custkey // 11 % 6 + 1] AS rights, (['mast', 'eso', 'irsa', 'noirlab'])[c_custkey // 13 % 4 + 1] AS provider FROM customer)"""


def p22_provider_rights(s, d):
    return _products(s, d).select("product_id", C.redistributable(F.col("provider"), F.col("collection"), F.col("rights")).alias("redistributable"))


def p23_usable_products(s, d):
    return _products(s, d).where(C.usable_product(F.col("filename"), F.col("product_type"), F.col("calibration"))).select("product_id")


def a39_redistributable_count(s, d):
    return _products(s, d).groupBy("provider").agg(F.count_if(C.redistributable(F.col("provider"), F.col("collection"), F.col("rights"))).alias("redistributable"), F.count(F.lit(1)).alias("candidates"))


def t13_preferred_product(s, d):
    """The product of each observation to take: best subgroup, highest calibration, first name."""
    rank = F.struct(C.subgroup_rank(F.coalesce("subgroup", F.lit(""))).alias("rank"), (-F.coalesce("calibration", F.lit(0))).alias("minus"), F.col("filename"), F.col("product_id"))
    return _products(s, d).groupBy("obs_id").agg(F.min(rank).alias("r")).select("obs_id", "r.product_id", "r.rank", "r.filename")


def p38_confident_items(s, d):
    """The first three items of a list that are surer than one half."""
    e = F.col("event_id")
    items = F.transform(F.sequence(F.lit(0), (e % 6).cast("int")), lambda i: F.struct(i.alias("n"), ((e * 7 + i * 13) % 100 / 100.0).alias("confidence")))
    sure = F.slice(F.filter(items, lambda x: x["confidence"] > 0.5), 1, 3)
    return S.table(s, d, "events").select("event_id", F.array_join(F.transform(sure, lambda x: x["n"].cast("string")), ",").alias("items"))


def p39_recoverable_failures(s, d):
    k = F.col("job_id")
    rows = S.jobs(s, d).select("job_id", _pick(k, "failed", "extracting", "rejected", "approved").alias("status"), _pick(F.floor(k / 4), "PROGRAMMINGERROR", "CALLEDPROCESSERROR", "VALUEERROR", None).alias("code"), _pick(F.floor(k / 16), "cannot adapt type 'dict' using placeholder", "exit 1 of solve-field", "too few finite image pixels", None).alias("detail"), _pick(F.floor(k / 5), "poor-fwhm,dense-clouds", "poor-fwhm", None).alias("reason"))
    return rows.where(C.recoverable(F.col("status"), F.col("code"), F.col("detail"), F.col("reason"))).select("job_id")


def _pointers(s, d):
    k = F.col("p_partkey")
    sha = F.sha2(k.cast("string"), 256)
    return S.table(s, d, "part").select(
        "p_partkey",
        _pick(k, "pointer-v1", "pointer-v1", "pointer-v1", "pointer-v0", None).alias("schema"),
        F.concat(_pick(F.floor(k / 5), "hips/r/", "hips/r/", "/hips/", "hips/../", "hips//"), k.cast("string")).alias("root_path"),
        F.concat(F.lit("hips/r/manifest"), _pick(F.floor(k / 7), ".json", ".json", "/", " .json")).alias("manifest_path"),
        F.when(k % 11 == 0, F.upper(sha)).otherwise(sha).alias("manifest_sha256"),
        F.when(k % 13 == 0, F.left(sha, F.lit(63))).otherwise(sha).alias("inventory_sha256"),
        F.when(k % 17 != 0, sha).alias("hipsgen_sha256"),
        (k % 19).cast("int").alias("source_count"),
        (k % 12 - 1).cast("int").alias("hips_order"),
        F.when(k % 23 == 0, "").otherwise("12.4").alias("hipsgen_version"),
        F.when(k % 29 != 0, "r").alias("spectral_filter"),
    )


def e17_pointers(s, d):
    return _pointers(s, d).select("p_partkey", C.broken(C.pointer_rules()).alias("invalid"))


def e03_published_tiles(s, d):
    k = F.col("p_partkey")
    path = F.concat(_pick(k, "hips/", "hips/", "masters/"), _pick(F.floor(k / 3), "a/", "../"), k.cast("string"), _pick(F.floor(k / 6), ".webp", ".webp", ".WEBP", ".png"))
    rows = S.table(s, d, "part").select("p_partkey", F.when(k % 25 != 0, path).alias("path"))
    return rows.select("p_partkey", F.when(C.published_tile(F.col("path")), F.concat(F.lit("https://sky.example/storage/v1/object/public/astro-derived/"), F.col("path"))).otherwise("uncovered").alias("target"))


def e20_derivative_urls(s, d):
    k = F.col("p_partkey")
    path = F.concat(_pick(k, "masters/", "masters/", "hips/", "masters//"), F.replace("p_name", F.lit(" "), _pick(F.floor(k / 4), " ", "/", "é", "(x)", "\\")), _pick(F.floor(k / 20), ".fits", ".FITS", ".png"))
    rows = S.table(s, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", C.derivative_url(F.lit("https://sky.example"), F.col("path"), "masters/", ".fits").alias("url"))


def e18_active(s, d):
    k = F.col("o_orderkey")
    rows = S.table(s, d, "orders").select("o_orderkey", F.when(k % 4 != 0, (k % 3).cast("int")).alias("active"), _pick(F.floor(k / 12), "discovering", "complete", "failed", None, "building").alias("run"), _pick(F.floor(k / 60), "verifying", "complete", None).alias("build"))
    return rows.select("o_orderkey", C.is_active(F.col("active"), F.col("run"), F.col("build")).alias("is_active"))


def e42_cone_parameters(s, d):
    e = F.col("event_id")
    rows = S.table(s, d, "events").select(e, (e % 400).cast("double").alias("ra"), (e % 200 - 100).cast("double").alias("dec"), (e % 12).cast("double").alias("radius"), (e % 1100).alias("most"))
    return rows.select("event_id", C.broken(C.cone_rules(*map(F.col, ("ra", "dec", "radius", "most")))).alias("invalid"))


def m22_metrics_valid(s, d):
    k = F.col("l_linenumber") + F.col("l_orderkey")
    f = S.table(s, d, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"),
        F.when(k % 41 == 0, float("nan")).otherwise(F.col("l_quantity")).alias("matched_stars"), F.when(k % 43 == 0, float("inf")).otherwise(F.col("l_tax")).alias("wcs_rms_px"), (F.col("l_discount") * 12).alias("usable_coverage"), F.col("l_quantity").alias("fwhm_arcsec"),
        (k % 30).cast("double").alias("pixel_scale_arcsec"), F.col("l_tax").alias("eccentricity"), F.when(k % 47 != 0, F.col("l_discount")).alias("saturated_fraction"), (F.col("l_tax") - 0.01).alias("clipped_black_fraction"), F.col("l_quantity").alias("signal_to_noise"), F.when(k % 3 != 0, (k % 37).cast("double")).alias("native_pixel_scale_arcsec"),
    )
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", C.metrics_valid().alias("valid"))


QUERIES = {
    f.__name__: f
    for f in (
        p21_live_uploads, p22_provider_rights, p23_usable_products, p25_upload_metadata, p26_acceptable_files, p27_vision_gate, p28_owner_conflicts, p29_runs_without_target, p31_master_paths, p32_trusted_archives,
        p33_allowed_urls, p38_confident_items, p39_recoverable_failures, a39_redistributable_count, t13_preferred_product, e03_published_tiles, e17_pointers, e18_active, e20_derivative_urls, e42_cone_parameters, m22_metrics_valid,
    )
}

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _names(rules: dict[str, str]) -> str:
    """SQL for the names of the rules that don't hold."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{n}' END" for n, ok in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


_EXTENSION = "lower(list_last(string_split(filename, '.')))"
_PUBLIC = "coalesce(NOT (" + " OR ".join(f"contains(lower(trim(rights)), '{w}')" for w in C.PRIVATE_RIGHTS) + f") AND (lower(trim(rights)) IN ({_IN(C.PUBLIC_RIGHTS)}) OR starts_with(lower(trim(rights)), 'public')), false)"
_REDIST = "CASE WHEN " + " OR ".join(f"contains(lower(collection), '{m}')" for m in C.COPYRIGHTED_MARKERS) + f" THEN false WHEN provider IN ('eso', 'mast') THEN {_PUBLIC} WHEN provider = 'irsa' THEN rights IS NULL OR {_PUBLIC} ELSE false END"
_UPLOAD_RULES = {
    "filename": "length(filename) BETWEEN 1 AND 255", "size_bytes": "size_bytes > 0 AND size_bytes <= 5368709120", "object_id": "length(object_id) BETWEEN 1 AND 50", "kind": f"kind IN ({_IN(C.KINDS)})", "licence": f"licence IN ({_IN(C.LICENCES)})",
    "focal_length_mm": "focal_length_mm IS NULL OR (focal_length_mm > 0 AND focal_length_mm <= 100000)", "pixel_size_um": "pixel_size_um > 0 AND pixel_size_um <= 100", "exposure_s": "exposure_s > 0 AND exposure_s <= 86400", "gain": "gain BETWEEN 0 AND 1000000",
    "temperature_c": "temperature_c BETWEEN -273.15::DOUBLE AND 200", "binning": "binning BETWEEN 1 AND 8", "latitude": "latitude BETWEEN -90 AND 90", "longitude": "longitude IS NULL OR longitude BETWEEN -180 AND 180",
}
_SAFE = lambda c: f"starts_with({c}, 'hips/') AND regexp_full_match({c}, '[a-zA-Z0-9._/-]+') AND NOT contains({c}, '..') AND NOT contains({c}, '//') AND NOT ends_with({c}, '/')"
_HEX = lambda c: f"regexp_full_match({c}, '[0-9a-f]{{64}}')"
_POINTER_RULES = {
    "schema": "schema = 'pointer-v1'", "root_path": _SAFE("root_path"), "manifest_path": _SAFE("manifest_path"), "manifest_sha256": _HEX("manifest_sha256"), "inventory_sha256": _HEX("inventory_sha256"), "hipsgen_sha256": _HEX("hipsgen_sha256"),
    "source_count": "source_count >= 1", "hips_order": "hips_order BETWEEN 0 AND 9", "hipsgen_version": "length(hipsgen_version) >= 1", "spectral_filter": "length(spectral_filter) >= 1",
}

ORACLES = {
    "p21_live_uploads": f"WITH {S.UPLOADS} SELECT upload_id, object_id FROM uploads WHERE deleted_at IS NULL",
    "p22_provider_rights": f"WITH {_PRODUCTS} SELECT product_id, {_REDIST} AS redistributable FROM products",
    "p23_usable_products": f"WITH {_PRODUCTS} SELECT product_id FROM products WHERE (ends_with(lower(filename), '.fits') OR ends_with(lower(filename), '.fz')) AND upper(product_type) = 'SCIENCE' AND (calibration IS NULL OR calibration >= 2)",
    "p25_upload_metadata": f"WITH {S.UPLOADS} SELECT upload_id, {_names(_UPLOAD_RULES)} AS invalid FROM uploads",
    "p26_acceptable_files": f"WITH {S.UPLOADS} SELECT upload_id, {_EXTENSION} AS extension, {_EXTENSION} IN ({_IN(C.EXTENSIONS)}) AND size_bytes > 0 AND size_bytes <= 5368709120 AS accepted FROM uploads",
    "p27_vision_gate": "WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS generated, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100 / 100.0::DOUBLE END AS confidence FROM labels) SELECT * FROM l WHERE NOT coalesce(generated AND confidence > 0.65::DOUBLE, false)",
    "p28_owner_conflicts": f"WITH {S.UPLOADS} SELECT upload_id, source_kind, user_id, archive_item_id FROM uploads WHERE CASE source_kind WHEN 'community' THEN user_id IS NULL OR archive_item_id IS NOT NULL ELSE user_id IS NOT NULL OR archive_item_id IS NULL END",
    "p29_runs_without_target": "SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0",
    "p31_master_paths": """WITH p AS (SELECT p_partkey, (['masters/', 'masters/', 'hips/'])[p_partkey % 3 + 1] || (['m31', 'M31', 'm31-r', 'm31-r', 'm3', ''])[p_partkey // 3 % 6 + 1] || '/' || p_partkey // 18 % 4 || CASE WHEN p_partkey % 5 > 0 THEN '/' || p_partkey || '.fits' ELSE '' END AS path FROM part)
        SELECT p_partkey, path, regexp_full_match(path, 'masters/[mM]31/.*') OR regexp_full_match(path, 'masters/m31-[^/]*/2/.*') AS fits FROM p""",
    "p32_trusted_archives": f"""WITH {S.UPLOADS} SELECT upload_id FROM uploads WHERE source_kind = 'public_archive' AND archive_item_id IS NOT NULL AND (upload_id % 3 = 0 OR upload_id // 9 % 2 = 1) AND upload_id % 2 = 0 AND upload_id // 18 % 4 < 2""",
    "p33_allowed_urls": f"SELECT page_id, coalesce(regexp_matches(lower(url), '^https://([^/?#@]*@)?({'|'.join(h.replace('.', chr(92) + '.') for h in HOSTS)})([:/?#]|$)'), false) AS allowed FROM pages",
    "p38_confident_items": "SELECT event_id, array_to_string(list_filter(range(0, event_id % 6 + 1), lambda i: (event_id * 7 + i * 13) % 100 > 50)[1:3], ',') AS items FROM events",
    "p39_recoverable_failures": """SELECT o_orderkey AS job_id FROM orders WHERE (o_orderkey % 4 < 2 AND o_orderkey // 4 % 4 = o_orderkey // 16 % 4 AND o_orderkey // 4 % 4 < 2) OR (o_orderkey % 4 = 0 AND o_orderkey // 4 % 4 = 2 AND o_orderkey // 16 % 4 = 2) OR (o_orderkey % 4 = 2 AND o_orderkey // 5 % 3 = 0)""",
    "a39_redistributable_count": f"WITH {_PRODUCTS} SELECT provider, count(*) FILTER (WHERE {_REDIST}) AS redistributable, count(*) AS candidates FROM products GROUP BY provider",
    "t13_preferred_product": f"WITH {_PRODUCTS}, r AS (SELECT *, coalesce(list_position(['DRC', 'DRZ', 'DLC', 'FLC', 'FLT'], upper(subgroup)) - 1, 50) AS rank FROM products) SELECT obs_id, product_id, CAST(rank AS INT) AS rank, filename FROM r QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY rank, coalesce(calibration, 0) DESC, filename, product_id) = 1",
    "e03_published_tiles": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 25 <> 0 THEN (['hips/', 'hips/', 'masters/'])[p_partkey % 3 + 1] || (['a/', '../'])[p_partkey // 3 % 2 + 1] || p_partkey || (['.webp', '.webp', '.WEBP', '.png'])[p_partkey // 6 % 4 + 1] END AS path FROM part)
        SELECT p_partkey, CASE WHEN regexp_full_match(path, 'hips/.*\\.webp') AND NOT contains(path, '..') THEN 'https://sky.example/storage/v1/object/public/astro-derived/' || path ELSE 'uncovered' END AS target FROM p""",
    "e17_pointers": f"""WITH p AS (SELECT p_partkey, (['pointer-v1', 'pointer-v1', 'pointer-v1', 'pointer-v0', NULL])[p_partkey % 5 + 1] AS schema, (['hips/r/', 'hips/r/', '/hips/', 'hips/../', 'hips//'])[p_partkey // 5 % 5 + 1] || p_partkey AS root_path, 'hips/r/manifest' || (['.json', '.json', '/', ' .json'])[p_partkey // 7 % 4 + 1] AS manifest_path,
        sha256(CAST(p_partkey AS VARCHAR)) AS sha, CASE WHEN p_partkey % 11 = 0 THEN upper(sha) ELSE sha END AS manifest_sha256, CASE WHEN p_partkey % 13 = 0 THEN left(sha, 63) ELSE sha END AS inventory_sha256, CASE WHEN p_partkey % 17 <> 0 THEN sha END AS hipsgen_sha256, p_partkey % 19 AS source_count, p_partkey % 12 - 1 AS hips_order,
        CASE WHEN p_partkey % 23 = 0 THEN '' ELSE '12.4' END AS hipsgen_version, CASE WHEN p_partkey % 29 <> 0 THEN 'r' END AS spectral_filter FROM part) SELECT p_partkey, {_names(_POINTER_RULES)} AS invalid FROM p""",
    "e18_active": """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 > 0 END, false) OR o_orderkey // 12 % 5 IN (0, 4) OR o_orderkey // 60 % 3 = 0 AS is_active FROM orders""",
    "e20_derivative_urls": r"""WITH p AS (SELECT p_partkey, (['masters/', 'masters/', 'hips/', 'masters//'])[p_partkey % 4 + 1] || replace(p_name, ' ', ([' ', '/', 'é', '(x)', '\'])[p_partkey // 4 % 5 + 1]) || (['.fits', '.FITS', '.png'])[p_partkey // 20 % 3 + 1] AS path FROM part)
        SELECT p_partkey, CASE WHEN starts_with(path, 'masters/') AND ends_with(lower(path), '.fits') AND NOT contains(path, '\') AND NOT contains(path, '//') THEN 'https://sky.example/storage/v1/object/public/astro-derived/' || replace(replace(path, ' ', '%20'), 'é', '%C3%A9') END AS url FROM p""",
    "e42_cone_parameters": "SELECT event_id, " + _names({"ra": "event_id % 400 < 360", "dec": "event_id % 200 - 100 BETWEEN -90 AND 90", "radius": "event_id % 12 BETWEEN 1 AND 10", "records": "event_id % 1100 BETWEEN 1 AND 1000"}) + " AS invalid FROM events",
    "m22_metrics_valid": """WITH k AS (SELECT *, l_linenumber + l_orderkey AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, k % 41 <> 0 AND k % 43 <> 0 AND l_discount * 12 BETWEEN 0 AND 1 AND k % 30 > 0 AND l_tax BETWEEN 0 AND 1 AND k % 47 <> 0 AND l_discount BETWEEN 0 AND 1 AND l_tax - 0.01::DOUBLE BETWEEN 0 AND 1
        AND (k % 3 = 0 OR k % 37 > 0) AS valid FROM k""",
}
