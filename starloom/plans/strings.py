"""Text helpers, routes, names and JSON records, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import contracts as C
from starloom.functions import text as X
from starloom.sources import tables as S

RULES = (("lune|moon", "moon"), ("almond|sol", "sun"), ("star ?trail|lin", "trails"), ("steel|tin", "metal"), ("été|blue", "summer"))
POOL = ("ring", "globular", "lagoon", "veil", "crab", "owl", "eagle")


def _part(s, d):
    return S.table(s, d, "part")


def _pick(key, *values):
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def f08_routes(s, d):
    text = F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_size") % 9 == 0, "ÉTÉ"))
    return _part(s, d).select("p_partkey", X.routed(text, RULES, POOL).alias("label"), X.pool_index(text, len(POOL)).alias("pool"))


def f09_short_names(s, d):
    mail = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 5 > 0, "@example.org").otherwise(""))
    return S.table(s, d, "customer").select("c_custkey", X.truncated(F.col("c_name"), 10).alias("short"), X.mail_name(mail).alias("name"), X.title(F.concat_ws("_", F.lower("c_mktsegment"), F.lit("shower"))).alias("title"))


def f10_repaired(s, d):
    """Names that lost a character take the known ones; names without a known one stay."""
    broken = _part(s, d).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.left("p_name", F.lit(4)), F.lit("�"))).otherwise(F.col("p_name")).alias("name"))
    known = _part(s, d).where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("known"))
    return broken.join(known, "p_partkey", "left").select("p_partkey", X.repaired(F.col("name"), F.col("known")).alias("name"))


def f13_instrument_groups(s, d):
    k = F.col("p_partkey")
    return _part(s, d).select("p_partkey", X.instrument_group(F.col("p_brand"), F.when(k % 4 > 0, F.col("p_name")), F.when(k % 3 > 0, F.repeat(F.col("p_type"), F.lit(12))), F.lit("R")).alias("instrument_group"))


def f14_layer_slugs(s, d):
    k = F.col("p_partkey")
    band = _pick(k, "g", "r", "i", "z", "y", "u", "gr")
    return _part(s, d).select("p_partkey", X.seed_slug(band, F.lit(4), k - 3).alias("seed"), X.parent_slug(F.when(k % 5 == 0, " -- ").otherwise(F.concat_ws(" ", F.lit("NGC"), F.col("p_brand"))), band).alias("parent"), X.global_slug(band).alias("global_layer"))


def f16_properties(s, d):
    k = F.col("p_partkey")
    return _part(s, d).select("p_partkey", X.properties_text([("creator_did", F.concat(F.lit("ivo://sky/"), k.cast("string"))), ("obs_title", F.when(k % 3 > 0, F.col("p_name"))), ("hips_order", (k % 10).cast("string")), ("hips_frame", F.lit("equatorial"))]).alias("body"))


def f18_file_names(s, d):
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/a.fits?x=1#y").when(F.col("page_id") % 3 == 1, "/b/").otherwise(""))
    return S.table(s, d, "pages").select("page_id", X.url_file_name(url, F.col("page_id").cast("string")).alias("file"))


def f20_directions(s, d):
    e = F.col("event_id")
    return S.table(s, d, "events").select("event_id", X.relative_direction((e * 29 % 3600 / 10.0), (e * 53 % 360).cast("double")).alias("direction"))


def f21_extensions(s, d):
    return S.uploads(s, d).select("upload_id", C.extension(F.col("filename")).alias("extension"))


def x06_without_key(s, d):
    m = F.create_map(F.lit("mode"), F.col("p_brand"), F.lit("retry_state"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    kept = F.map_filter(m, lambda k, _: k != "retry_state")
    return _part(s, d).select("p_partkey", F.to_json(kept).alias("payload"))


def _texts(s, d):
    k = F.col("event_id")
    body = _pick(k, '{"a": 1}', "[1, 2]", '"text"', "3.5", "true", "null", "{broken")
    return S.table(s, d, "events").select("event_id", F.when(k % 9 != 0, F.when(k % 7 == 0, F.col("props")).otherwise(body)).alias("body"))


def x07_json_kinds(s, d):
    """The kind of each JSON text; null for what is no JSON."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json("body")), "^[A-Z]+", 0)
    names = F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind != "", "number")
    return _texts(s, d).select("event_id", names.alias("kind"))


def x13_json_objects(s, d):
    """Texts that decode to an object; others as null."""
    v = F.try_parse_json("body")
    return _texts(s, d).select("event_id", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.coalesce(F.try_variant_get(v, "$.a", "int"), F.try_variant_get(v, "$.k", "int"), F.lit(-1))).alias("value"))


def x04_typed_elements(s, d):
    """A row for each element of a JSON array, cast to its types; elements that don't cast are null."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('[{"order": '), (k % 10).cast("string"), F.lit(', "index": '), k.cast("string"), F.lit('}, {"order": 3, "index": '), (k * 7).cast("string"), F.lit("}]"))
    rows = _part(s, d).select("p_partkey", F.posexplode(F.from_json(body, "array<struct<order:int,index:bigint>>")).alias("place", "e"))
    return rows.select("p_partkey", "place", "e.order", "e.index")


def x14_cutouts(s, d):
    """Addresses with a centre and a size put in, whatever they had; other hosts stay."""
    k = F.col("p_partkey")
    url = F.concat(F.when(k % 4 == 0, "https://other.example/ibe/data/").otherwise("https://archive.example/ibe/data/"), k.cast("string"), _pick(k, "", "?size=9deg", "?a=1&center=0,0", "?b="))
    pairs = F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin("center", "size", "gzip"))
    query = F.concat_ws("&", F.array_join(pairs, "&"), F.lit("center=10.0000000000%2C-5.0000000000deg&size=0.5000000000deg&gzip=false"))
    cut = F.concat(F.substring_index("url", "?", 1), F.lit("?"), F.ltrim(query, F.lit("&")))
    return _part(s, d).select("p_partkey", url.alias("url")).select("p_partkey", F.when(F.startswith("url", F.lit("https://archive.example/ibe/data/")), cut).otherwise(F.col("url")).alias("url"))


def x03_joined_arrays(s, d):
    k = F.col("p_partkey")
    a, b = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: (k + i) % 5), F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: (k * 2 + i) % 5)
    return _part(s, d).select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.concat(a, b))).cast("array<string>"), ",").alias("joined"), F.size(F.concat(a, b)).alias("n"))


def x12_canonical_rows(s, d):
    """Rows as JSON with the shorter keys first, then by bytes, as a plan's hash takes them."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"mag": '), F.col("p_size").cast("string"), F.lit(', "slug": "'), F.lower("p_brand"), F.lit('", "index": '), k.cast("string"), F.lit(', "order": '), (k % 10).cast("string"), F.lit("}"))
    return _part(s, d).select("p_partkey", F.sha2(body, 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (f08_routes, f09_short_names, f10_repaired, f13_instrument_groups, f14_layer_slugs, f16_properties, f18_file_names, f20_directions, f21_extensions, x03_joined_arrays, x04_typed_elements, x06_without_key, x07_json_kinds, x12_canonical_rows, x13_json_objects, x14_cutouts)
}

_ROUTE_TEXT = "concat_ws(' ', p_name, p_brand, CASE WHEN p_size % 9 = 0 THEN 'ÉTÉ' END)"
_TEXTS = """texts AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN props ELSE (['{"a": 1}', '[1, 2]', '"text"', '3.5', 'true', 'null', '{broken'])[event_id % 7 + 1] END END AS body FROM events)"""

ORACLES = {
    "f08_routes": f"""WITH t AS (SELECT p_partkey, {_ROUTE_TEXT} AS t FROM part), h AS (SELECT *, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(t, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296) % 7 AS pool FROM t)
        SELECT p_partkey, {"CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{label}'" for p, label in RULES) + " ELSE"} ({list(POOL)})[pool::INT + 1] END AS label, pool::INT AS pool FROM h""",
    "f09_short_names": "SELECT c_custkey, left(c_name, 10) AS short, c_name AS name, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Shower' AS title FROM customer",
    "f10_repaired": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 0 THEN left(p_name, 4) || chr(65533) ELSE p_name END AS name FROM part",
    "f13_instrument_groups": "SELECT p_partkey, left(lower(replace(p_brand || ':' || CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE 'unknown-facility' END || ':' || CASE WHEN p_partkey % 3 > 0 THEN repeat(p_type, 12) ELSE 'unknown-instrument' END || ':R', ' ', '-')), 160) AS instrument_group FROM part",
    "f14_layer_slugs": """WITH b AS (SELECT *, (['g', 'r', 'i', 'z', 'y', 'u', 'gr'])[p_partkey % 7 + 1] AS band FROM part) SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 AND p_partkey >= 3 THEN 'sky-ps1-' || band || '-o4-' || (p_partkey - 3) END AS seed,
        CASE WHEN p_partkey % 7 < 5 AND p_partkey % 5 > 0 THEN 'sky-ps1-' || band || '-parent-ngc' || lower(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g')) END AS parent, CASE WHEN p_partkey % 7 < 5 THEN 'sky-ps1-' || band || '-global-loworder' END AS global_layer FROM b""",
    "f16_properties": "SELECT p_partkey, 'creator_did = ivo://sky/' || p_partkey || chr(10) || CASE WHEN p_partkey % 3 > 0 THEN 'obs_title = ' || p_name || chr(10) ELSE '' END || 'hips_order = ' || p_partkey % 10 || chr(10) || 'hips_frame = equatorial' || chr(10) AS body FROM part",
    "f18_file_names": """WITH u AS (SELECT page_id, url || (['/a.fits?x=1#y', '/b/', ''])[page_id % 3 + 1] AS u FROM pages), p AS (SELECT page_id, regexp_extract(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3), '([^/]*)/*$', 1) AS name FROM u)
        SELECT page_id, CASE WHEN contains(name, '.') THEN left(name, 240) ELSE 'archive-' || left(sha256(CAST(page_id AS VARCHAR)), 20) || '.fits' END AS file FROM p""",
    "f20_directions": """WITH t AS (SELECT event_id, fmod(event_id * 29 % 3600 / 10.0::DOUBLE - (event_id * 53 % 360)::DOUBLE + 540.0::DOUBLE, 360.0::DOUBLE) - 180.0::DOUBLE AS turn FROM events)
        SELECT event_id, CASE WHEN abs(turn) < 10 THEN 'droit devant vous' WHEN abs(turn) > 150 THEN 'derrière vous (faites demi-tour)' ELSE CAST(floor(abs(turn) + 0.5) AS BIGINT) || '° ' || CASE WHEN turn > 0 THEN 'vers la droite' ELSE 'vers la gauche' END END AS direction FROM t""",
    "f21_extensions": f"WITH {S.UPLOADS} SELECT upload_id, lower(list_last(string_split(filename, '.'))) AS extension FROM uploads",
    "x03_joined_arrays": """WITH a AS (SELECT p_partkey, list_concat(list_transform(range(0, p_partkey % 3 + 1), lambda i: (p_partkey + i) % 5), list_transform(range(0, p_partkey % 4 + 1), lambda i: (p_partkey * 2 + i) % 5)) AS l FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(l)), ',') AS joined, len(l) AS n FROM a""",
    "x04_typed_elements": "SELECT p_partkey, i AS place, CASE WHEN i = 0 THEN p_partkey % 10 ELSE 3 END AS \"order\", CASE WHEN i = 0 THEN p_partkey ELSE p_partkey * 7 END AS index FROM part, range(0, 2) r(i)",
    "x06_without_key": """SELECT p_partkey, '{"mode":"' || p_brand || '","size":"' || p_size || '"}' AS payload FROM part""",
    "x07_json_kinds": f"""WITH {_TEXTS} SELECT event_id, CASE WHEN json_valid(body) THEN CASE json_type(body) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind FROM texts""",
    "x12_canonical_rows": """SELECT p_partkey, sha256('{"mag": ' || p_size || ', "slug": "' || lower(p_brand) || '", "index": ' || p_partkey || ', "order": ' || p_partkey % 10 || '}') AS sha256 FROM part""",
    "x13_json_objects": f"""WITH {_TEXTS} SELECT event_id, CASE WHEN json_valid(body) THEN CASE json_type(body) WHEN 'OBJECT' THEN coalesce(CAST(json_extract_string(body, '$.a') AS INT), CAST(json_extract_string(body, '$.k') AS INT), -1) END END AS value FROM texts""",
    "x14_cutouts": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'https://other.example/ibe/data/' || p_partkey ELSE 'https://archive.example/ibe/data/' || p_partkey || '?' || (['', '', 'a=1&', 'b=&'])[p_partkey % 4 + 1] || 'center=10.0000000000%2C-5.0000000000deg&size=0.5000000000deg&gzip=false' END AS url FROM part""",
}
