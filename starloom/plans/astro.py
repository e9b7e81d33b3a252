"""Ephemeris and sky-search queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import astro as A
from starloom.functions.maths import half_up
from starloom.operators import sky as K
from starloom.sources import tables as S

NOW, LAT, LON = dt.datetime(2024, 1, 15, 21, 30), 46.2, 6.1
EVENTS_FROM, EVENT_DAYS = dt.datetime(2024, 1, 1), 240
#: Column, the Sun's altitude in degrees, and whether it goes down through it.
TWILIGHTS = (("sunset", -0.833, True), ("sunrise", -0.833, False), ("nautical_dusk", -12.0, True), ("astronomical_dusk", -18.0, True), ("astronomical_dawn", -18.0, False))


def _dates(s, d):
    return S.table(s, d, "orders").select(F.col("o_orderdate").alias("at")).distinct().withColumn("d", A.day_number(F.col("at")))


def _round(df, digits, *columns):
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


def m14_twilight(s, d):
    """Sunset, sunrise, and the dusks and dawns of each day of a table, in minutes of the day."""
    times = _dates(s, d).select(F.col("at").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(288))).alias("k"))
    at = F.timestamp_add("MINUTE", F.col("k") * 5, F.col("day"))
    rows = A.with_sun(times.withColumn("d", A.day_number(at)))
    alt = A.altitude(A.sidereal(F.col("d"), LON), F.col("sun_ra"), F.col("sun_dec"), LAT)
    samples = rows.select("day", "k", alt.alias("alt")).withColumn("before", F.lag("alt").over(W.partitionBy("day").orderBy("k")))
    edges = []
    for name, height, down in TWILIGHTS:
        now, before = F.col("alt") < height, F.col("before") < height
        edges.append(F.min(F.when(~before & now if down else before & ~now, F.col("k") * 5)).alias(name))
    return samples.groupBy("day").agg(*edges)


def q34_upcoming_events(s, d):
    """Events in the sky, each with the number of reports of its day."""
    sky = K.upcoming_events(s, EVENTS_FROM, EVENT_DAYS)
    reports = S.table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_reports"))
    met = sky.join(reports, F.to_date("at") == F.col("day"), "left").drop("day")
    return met.withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))


QUERIES = {
    "m14_twilight": m14_twilight,
    "d01_day_numbers": lambda s, d: _round(S.observations(s, d).select("observation_id", A.day_number(F.col("observed_at")).alias("day_number"), A.julian_day(F.col("observed_at")).alias("julian_day"), A.sidereal(A.day_number(F.col("observed_at")), LON).alias("sidereal")), 5, "day_number", "julian_day", "sidereal"),
    "m09_sun": lambda s, d: _round(A.with_sun(_dates(s, d)).select("at", "sun_lon", "sun_ra", "sun_dec", "sun_dist"), 6, "sun_lon", "sun_ra", "sun_dec", "sun_dist"),
    "m10_moon": lambda s, d: _round(A.with_moon(A.with_sun(_dates(s, d))).select("at", "moon_ra", "moon_dec", "moon_dist_km", "moon_phase", "moon_illumination"), 5, "moon_ra", "moon_dec", "moon_dist_km", "moon_phase", "moon_illumination"),
    "m11_planets": lambda s, d: _round(A.with_planets(A.with_sun(_dates(s, d))).select("at", "planet", "planet_ra", "planet_dec", "planet_dist", "magnitude"), 5, "planet_ra", "planet_dec", "planet_dist", "magnitude"),
    "m03_altaz": lambda s, d: _round(K.positions_at(S.objects(s, d), NOW, LAT, LON).select("object_id", "alt", "az", "alt_refracted"), 6, "alt", "az", "alt_refracted"),
    "m13_rise_and_set": lambda s, d: K.rise_and_set(S.objects(s, d), NOW.date(), LAT, LON),
    "q32_search_sky": lambda s, d: _round(K.search(S.objects(s, d), NOW, LAT, LON, max_mag=30.0, min_altitude=20.0, text="g").select("object_id", "name", "mag", "alt"), 6, "alt"),
    "q33_highlights": lambda s, d: _round(K.highlights(S.objects(s, d), NOW, LAT, LON).select("object_id", "name", "alt", "score"), 6, "alt", "score"),
    "q34_upcoming_events": q34_upcoming_events,
}

_REV = lambda x: f"fmod(fmod({x}, 360::DOUBLE) + 360, 360::DOUBLE)"
_S = lambda x: f"sin(radians({x}))"
_C = lambda x: f"cos(radians({x}))"
_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def _day_sql(ts: str) -> str:
    return f"""CAST(367 * year({ts}) - floor(7 * (year({ts}) + floor((month({ts}) + 9) / 12)) / 4) + floor(275 * month({ts}) / 9) + day({ts}) - 730530 AS DOUBLE)
 + (hour({ts}) + minute({ts}) / 60 + (microsecond({ts}) / 1e6::DOUBLE) / 3600) / 24"""


#: From times(i, at, d) to sun(..., sun_lon, sun_dist, sun_ra, sun_dec).
_SUN = f"""sun1 AS (SELECT *, 282.9404::DOUBLE + 4.70935e-5::DOUBLE * d AS w, 0.016709::DOUBLE - 1.151e-9::DOUBLE * d AS e, {_REV("356.047::DOUBLE + 0.9856002585::DOUBLE * d")} AS m, radians(23.4393::DOUBLE - 3.563e-7::DOUBLE * d) AS ecl FROM times),
 sun2 AS (SELECT *, m + degrees(e * {_S("m")} * (1 + e * {_C("m")})) AS ea FROM sun1), sun3 AS (SELECT *, {_C("ea")} - e AS xv, sqrt(1 - e * e) * {_S("ea")} AS yv FROM sun2),
 sun4 AS (SELECT i, "at", d, ecl, {_REV("degrees(atan2(yv, xv)) + w")} AS sun_lon, sqrt(xv * xv + yv * yv) AS sun_dist FROM sun3),
 sun AS (SELECT *, {_REV(f"degrees(atan2({_S('sun_lon')} * cos(ecl), {_C('sun_lon')}))")} AS sun_ra, degrees(asin({_S("sun_lon")} * sin(ecl))) AS sun_dec FROM sun4)"""


def _kepler(name: str, source: str) -> str:
    """CTEs that add ea to a relation with m and e: twelve Newton steps."""
    out = [f"{name}0 AS (SELECT *, m + degrees(e * {_S('m')} * (1 + e * {_C('m')})) AS ea FROM {source})"]
    out += [f"{name}{k} AS (SELECT * REPLACE (ea - (ea - degrees(e * {_S('ea')}) - m) / (1 - e * {_C('ea')}) AS ea) FROM {name}{k - 1})" for k in range(1, 13)]
    return ", ".join(out)


_HELIO = lambda name, source: f"""{name}a AS (SELECT *, a * ({_C("ea")} - e) AS xv, a * sqrt(1 - e * e) * {_S("ea")} AS yv FROM {source}), {name}b AS (SELECT *, degrees(atan2(yv, xv)) + w AS l, sqrt(xv * xv + yv * yv) AS hr FROM {name}a),
 {name} AS (SELECT *, hr * ({_C("n")} * {_C("l")} - {_S("n")} * {_S("l")} * {_C("inc")}) AS hx, hr * ({_S("n")} * {_C("l")} + {_C("n")} * {_S("l")} * {_C("inc")}) AS hy, hr * {_S("l")} * {_S("inc")} AS hz FROM {name}b)"""  # noqa: E731
_EQ = lambda lon, lat, p: f"""{_REV(f"degrees(atan2({_S(lon)} * {_C(lat)} * cos(ecl) - {_S(lat)} * sin(ecl), {_C(lon)} * {_C(lat)}))")} AS {p}_ra, degrees(asin({_S(lon)} * {_C(lat)} * sin(ecl) + {_S(lat)} * cos(ecl))) AS {p}_dec"""

_MOON = f"""lun AS (SELECT *, {_REV("125.1228::DOUBLE - 0.0529538083::DOUBLE * d")} AS n, 5.1454::DOUBLE AS inc, {_REV("318.0634::DOUBLE + 0.1643573223::DOUBLE * d")} AS w, 60.2666::DOUBLE AS a, 0.0549::DOUBLE AS e, {_REV("115.3654::DOUBLE + 13.0649929509::DOUBLE * d")} AS m FROM sun),
 {_kepler("lk", "lun")}, {_HELIO("lh", "lk12")}, lp AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS r, {_REV("356.047::DOUBLE + 0.9856002585::DOUBLE * d")} AS ms, {_REV(f"{_REV('n + w + m')} - sun_lon")} AS dd, {_REV(f"{_REV('n + w + m')} - n")} AS f FROM lh),
 lq AS (SELECT *, {_REV("degrees(atan2(hy, hx))")} - 1.274::DOUBLE * {_S("m - 2 * dd")} + 0.658::DOUBLE * {_S("2 * dd")} - 0.186::DOUBLE * {_S("ms")} - 0.059::DOUBLE * {_S("2 * m - 2 * dd")} - 0.057::DOUBLE * {_S("m - 2 * dd + ms")} + 0.053::DOUBLE * {_S("m + 2 * dd")}
 + 0.046::DOUBLE * {_S("2 * dd - ms")} + 0.041::DOUBLE * {_S("m - ms")} - 0.035::DOUBLE * {_S("dd")} - 0.031::DOUBLE * {_S("m + ms")} - 0.015::DOUBLE * {_S("2 * f - 2 * dd")} + 0.011::DOUBLE * {_S("m - 4 * dd")} AS lon,
 degrees(asin(hz / r)) - 0.173::DOUBLE * {_S("f - 2 * dd")} - 0.055::DOUBLE * {_S("m - f - 2 * dd")} - 0.046::DOUBLE * {_S("m + f - 2 * dd")} + 0.033::DOUBLE * {_S("f + 2 * dd")} + 0.017::DOUBLE * {_S("2 * m + f")} AS lat,
 r - 0.58::DOUBLE * {_C("m - 2 * dd")} - 0.46::DOUBLE * {_C("2 * dd")} AS dist FROM lp),
 moon AS (SELECT i, "at", d, sun_lon, dist * 6371 AS moon_dist_km, {_REV("lon - sun_lon")} / 360 AS moon_phase, (1 + {_C("180 - (lon - sun_lon)")}) / 2 AS moon_illumination, {_EQ("lon", "lat", "moon")} FROM lq)"""
_ELEMENTS = "elements(planet, n0, n1, i0, i1, w0, w1, a0, a1, e0, e1, m0, m1, base) AS (VALUES " + ", ".join(f"('{p}', " + ", ".join(f"{x!r}::DOUBLE" for pair in v[:-1] for x in pair) + f", {v[-1]}::DOUBLE)" for p, v in A.PLANETS.items()) + ")"
_PLANETS = f"""{_ELEMENTS}, pe AS (SELECT s.*, planet, base, n0 + n1 * d AS n, i0 + i1 * d AS inc, w0 + w1 * d AS w, a0 + a1 * d AS a, e0 + e1 * d AS e, {_REV("m0 + m1 * d")} AS m FROM sun s, elements), {_kepler("pk", "pe")}, {_HELIO("ph", "pk12")},
 pg AS (SELECT *, hx + sun_dist * {_C("sun_lon")} AS gx, hy + sun_dist * {_S("sun_lon")} AS gy FROM ph), pr AS (SELECT *, sqrt(gx * gx + gy * gy + hz * hz) AS planet_dist FROM pg),
 ps AS (SELECT *, degrees(atan2(gy, gx)) AS lon, degrees(asin(hz / planet_dist)) AS lat, degrees(acos(least(greatest((hr * hr + planet_dist * planet_dist - sun_dist * sun_dist) / (2 * hr * planet_dist), -1), 1))) AS pa FROM pr),
 planets AS (SELECT i, "at", planet, planet_dist, base + 5 * log10(hr * planet_dist) + 0.013::DOUBLE * pa AS magnitude, sun_ra, sun_dec, {_EQ("lon", "lat", "planet")} FROM ps)"""
_TIMES = f"""times AS (SELECT 0 AS i, "at", {_day_sql('"at"')} AS d FROM (SELECT DISTINCT o_orderdate AS "at" FROM orders))"""


def _lst(d: str) -> str:
    return _REV(f"""{_REV(f"282.9404::DOUBLE + 4.70935e-5::DOUBLE * ({d}) + (356.047::DOUBLE + 0.9856002585::DOUBLE * ({d})) + 180")} + (({d}) - floor({d})) * 24 * 15.04107::DOUBLE + {LON}::DOUBLE""")


def _alt(lst: str) -> str:
    return f'degrees(asin(least(greatest({_S(chr(34) + "dec" + chr(34))} * {_S(f"{LAT}::DOUBLE")} + {_C(chr(34) + "dec" + chr(34))} * {_C(f"{LAT}::DOUBLE")} * {_C(f"{lst} - ra")}, -1), 1)))'


_ALTAZ = f"""sky1 AS (SELECT *, {_lst(f"{K.day_of(NOW)!r}::DOUBLE")} AS lst FROM objects), sky AS (SELECT *, {_alt("lst")} AS alt,
 {_REV(f'degrees(atan2(-{_S("lst - ra")} * {_C(chr(34) + "dec" + chr(34))}, {_S(chr(34) + "dec" + chr(34))} * {_C(f"{LAT}::DOUBLE")} - {_C(chr(34) + "dec" + chr(34))} * {_S(f"{LAT}::DOUBLE")} * {_C("lst - ra")}))')} AS az FROM sky1)"""
_DAY0 = f"{K.day_of(dt.datetime(NOW.year, NOW.month, NOW.day))!r}::DOUBLE"
_ALT_M = lambda m: _alt(_lst(f"{_DAY0} + ({m}) / 1440"))


def _bisect(name: str, source: str, rising: bool) -> str:
    out = [f"{name}0 AS (SELECT object_id, ra, \"dec\", {source} - 5 AS lo, {source} AS hi FROM ends WHERE {source} IS NOT NULL)"]
    low = f"{_ALT_M('(lo + hi) / 2')} {'<' if rising else '>='} -0.583"
    out += [f'{name}{k} AS (SELECT object_id, ra, "dec", CASE WHEN {low} THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {low} THEN hi ELSE (lo + hi) / 2 END AS hi FROM {name}{k - 1})' for k in range(1, 13)]
    return ", ".join(out)


_RISE = f"""samples AS (SELECT object_id, ra, "dec", k * 5::DOUBLE AS m, {_ALT_M("k * 5::DOUBLE")} AS alt, CASE WHEN k > 0 THEN {_ALT_M("(k - 1) * 5::DOUBLE")} END AS before FROM objects, range(0, 289) r(k)),
 ends AS (SELECT object_id, ra, "dec", min(m) FILTER (WHERE before < -0.583 AND alt >= -0.583) AS up, min(m) FILTER (WHERE before >= -0.583 AND alt < -0.583) AS down, max(alt) AS highest, min(alt) AS lowest,
 arg_max(m, (floor(alt * 1e6 + 0.5) / 1e6, -m)) AS top FROM samples GROUP BY ALL), {_bisect("bu", "up", True)}, {_bisect("bd", "down", False)}"""
_GRID = f"""times AS (SELECT i, "at", {_day_sql('"at"')} AS d FROM (SELECT i, TIMESTAMP '2024-01-01' + to_hours(6 * i) AS "at" FROM range(0, {EVENT_DAYS * 4 + 2}) r(i)))"""
_TURN = lambda v, t: f"(fmod(fmod({v} - {t} + 0.5::DOUBLE, 1::DOUBLE) + 1, 1::DOUBLE) - 0.5::DOUBLE)"
_CROSSED = lambda a, b, t: f"{_TURN(a, t)} < 0 AND {_TURN(b, t)} >= 0 AND abs({_TURN(a, t)}) < 0.1 AND abs({_TURN(b, t)}) < 0.1"
_SEP = lambda a, b, c, d: f"degrees(acos(least(greatest({_S(b)} * {_S(d)} + {_C(b)} * {_C(d)} * {_C(f'{a} - {c}')}, -1), 1)))"
_Q = lambda x: x.replace("'", "''")
_LABEL = "labels(body, label, n) AS (VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(K.LABELS.items())) + ")"
_SHOWER = "showers(name, m, dd, zhr) AS (VALUES " + ", ".join(f"('{s}', {m}, {d}, {z})" for s, m, d, z in K.SHOWERS) + ")"
_STEP = f"i BETWEEN 1 AND {EVENT_DAYS * 4}"
_DAYTEXT = "strftime(\"at\", '%Y-%m-%d')"
_EVENTS = f"""{_GRID}, {_SUN}, {_MOON}, {_PLANETS}, {_LABEL}, {_SHOWER}, seq AS (SELECT *, lag(moon_phase) OVER (ORDER BY i) AS phase0, lag(sun_lon) OVER (ORDER BY i) AS sun0 FROM moon),
 el AS (SELECT *, {_SEP("sun_ra", "sun_dec", "planet_ra", "planet_dec")} AS elong FROM planets), el2 AS (SELECT *, lag(elong) OVER (PARTITION BY planet ORDER BY i) AS elong0 FROM el),
 bodies AS (SELECT b.*, label, n FROM (SELECT i, "at", planet AS body, planet_ra AS ra, planet_dec AS de FROM planets UNION ALL SELECT i, "at", 'lune', moon_ra, moon_dec FROM moon) b JOIN labels USING (body)),
 pairs AS (SELECT a.i, a."at", a.body AS one, b.body AS two, a.label AS l1, b.label AS l2, {_SEP("a.ra", "a.de", "b.ra", "b.de")} AS sep FROM bodies a JOIN bodies b ON a.i = b.i AND a.n < b.n),
 near AS (SELECT *, lag(sep) OVER p AS sep0, lead(sep) OVER p AS sep2 FROM pairs WINDOW p AS (PARTITION BY one, two ORDER BY i)),
 every AS ({" UNION ALL ".join([f"SELECT 'moon-{label}-' || {_DAYTEXT} AS id, \"at\", 'lune' AS kind, '{label}' AS title, {rank} AS rank FROM seq WHERE {_STEP} AND {_CROSSED('phase0', 'moon_phase', f'{t}::DOUBLE')}" for t, label, rank in K.PHASES]
 + [f"SELECT 'season-{t}-' || {_DAYTEXT}, \"at\", 'saison', '{_Q(label)}', 3 FROM seq WHERE {_STEP} AND {_CROSSED('sun0 / 360', 'sun_lon / 360', f'{t}::DOUBLE / 360')}" for t, label in K.SEASONS]
 + [f"SELECT 'opp-' || planet || '-' || {_DAYTEXT}, \"at\", 'planete', 'Opposition de ' || label, 1 FROM el2 JOIN labels ON body = planet WHERE {_STEP} AND elong0 < 178 AND elong >= 178 AND planet IN ('mars', 'jupiter', 'saturne', 'uranus', 'neptune')",
 f"SELECT 'conj-' || one || '-' || two || '-' || {_DAYTEXT}, \"at\", 'conjonction', 'Rapprochement ' || l1 || ' – ' || l2, CASE WHEN sep < 1 THEN 1 ELSE 2 END FROM near WHERE {_STEP} AND sep < 3 AND sep < sep0 AND sep2 > sep",
 f"SELECT 'shower-' || name || '-' || y, make_timestamp(y, m, dd, 2, 0, 0), 'meteores', 'Maximum des ' || name, CASE WHEN zhr >= 80 THEN 1 ELSE 2 END FROM showers, (VALUES (2024), (2025)) v(y) WHERE make_timestamp(y, m, dd, 2, 0, 0) > TIMESTAMP '2024-01-01' AND make_timestamp(y, m, dd, 2, 0, 0) < TIMESTAMP '2024-01-01' + to_days({EVENT_DAYS})"])})"""

ORACLES = {
    "d01_day_numbers": f"""WITH x AS (SELECT event_id AS observation_id, {_day_sql("ts")} AS d, epoch_us(ts) // 1000 / 86400000 + 2440587.5::DOUBLE AS jd FROM events)
        SELECT observation_id, {_R("d", 5)} AS day_number, {_R("jd", 5)} AS julian_day, {_R(_lst("d"), 5)} AS sidereal FROM x""",
    "m09_sun": f'WITH {_TIMES}, {_SUN} SELECT "at", {_R("sun_lon", 6)} AS sun_lon, {_R("sun_ra", 6)} AS sun_ra, {_R("sun_dec", 6)} AS sun_dec, {_R("sun_dist", 6)} AS sun_dist FROM sun',
    "m10_moon": f'WITH {_TIMES}, {_SUN}, {_MOON} SELECT "at", ' + ", ".join(f"{_R(c, 5)} AS {c}" for c in ("moon_ra", "moon_dec", "moon_dist_km", "moon_phase", "moon_illumination")) + " FROM moon",
    "m11_planets": f"WITH {_TIMES}, {_SUN}, {_PLANETS} SELECT \"at\", planet, " + ", ".join(f"{_R(c, 5)} AS {c}" for c in ("planet_ra", "planet_dec", "planet_dist", "magnitude")) + " FROM planets",
    "m03_altaz": f"""WITH {S.OBJECTS}, {_ALTAZ} SELECT object_id, {_R("alt", 6)} AS alt, {_R("az", 6)} AS az, {_R("alt + CASE WHEN alt < -1 THEN 0 ELSE 0.0167::DOUBLE / tan(radians(alt + 7.31::DOUBLE / (alt + 4.4::DOUBLE))) END", 6)} AS alt_refracted FROM sky""",
    "m13_rise_and_set": f"""WITH {S.OBJECTS}, {_RISE} SELECT e.object_id, {_R("(u.lo + u.hi) / 2", 2)} AS rise_minute, {_R("(d.lo + d.hi) / 2", 2)} AS set_minute, top AS transit_minute, {_R("highest", 6)} AS highest,
        lowest > -0.583 AS always_up, highest < -0.583 AS never_up FROM ends e LEFT JOIN bu12 u USING (object_id) LEFT JOIN bd12 d ON d.object_id = e.object_id""",
    "q32_search_sky": f"""WITH {S.OBJECTS}, {_ALTAZ} SELECT object_id, name, mag, {_R("alt", 6)} AS alt FROM sky WHERE mag <= 30 AND alt >= 20 AND contains(lower(name), 'g') ORDER BY sky.alt DESC, object_id LIMIT 400""",
    "q33_highlights": f"""WITH {S.OBJECTS}, {_ALTAZ}, high AS (SELECT * FROM sky WHERE alt >= 15 ORDER BY alt DESC, object_id LIMIT 400), s AS (SELECT *, alt / 90 - mag / 20 + CASE WHEN kind_of_object = 'PROMO' THEN 0.6::DOUBLE ELSE 0 END AS sc FROM high)
        SELECT object_id, name, {_R("alt", 6)} AS alt, {_R("sc", 6)} AS score FROM s ORDER BY sc DESC, object_id LIMIT 12""",
    "q34_upcoming_events": f"""WITH {_EVENTS}, one AS (SELECT id, min("at") AS "at", any_value(kind) AS kind, any_value(title) AS title, arg_min(rank, "at") AS rank FROM every GROUP BY id), reports AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT one.*, coalesce(n, 0) AS n_reports FROM one LEFT JOIN reports ON day = CAST("at" AS DATE)""",
    "m14_twilight": f"""WITH slots AS (SELECT row_number() OVER () AS i, day, k, day + to_minutes(k * 5) AS "at" FROM (SELECT DISTINCT o_orderdate AS day FROM orders), range(0, 289) r(k)), times AS (SELECT i, "at", {_day_sql('"at"')} AS d FROM slots), {_SUN},
        high AS (SELECT day, k, {_alt("lst")} AS alt FROM (SELECT i, {_lst("d")} AS lst, sun_ra AS ra, sun_dec AS "dec" FROM sun) JOIN slots USING (i)), edge AS (SELECT *, lag(alt) OVER (PARTITION BY day ORDER BY k) AS before FROM high)
        SELECT day, {", ".join(f"min(k * 5) FILTER (WHERE {f'before >= {h} AND alt < {h}' if down else f'before < {h} AND alt >= {h}'}) AS {name}" for name, h, down in TWILIGHTS)} FROM edge GROUP BY day""",
}
