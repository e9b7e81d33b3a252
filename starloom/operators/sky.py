"""Sky searches over time: visibility of objects, rising and setting, highlights, and coming events."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import astro as A
from starloom.functions.geo import separation_deg
from starloom.functions.maths import half_up

HORIZON = -0.583
STEP_MINUTES = 5
AT_ONCE = 16_384

#: Names, seasons, lunar phases, and meteor showers (name, month, day, hourly rate).
LABELS = {"lune": "la Lune", "mercure": "Mercure", "venus": "Vénus", "mars": "Mars", "jupiter": "Jupiter", "saturne": "Saturne", "uranus": "Uranus", "neptune": "Neptune"}
SEASONS = ((0, "Équinoxe de printemps"), (90, "Solstice d'été"), (180, "Équinoxe d'automne"), (270, "Solstice d'hiver"))
PHASES = ((0.0, "Nouvelle lune", 1), (0.25, "Premier quartier", 3), (0.5, "Pleine lune", 1), (0.75, "Dernier quartier", 3))
SHOWERS = (("Quadrantides", 1, 3, 110), ("Lyrides", 4, 22, 18), ("Êta Aquarides", 5, 6, 50), ("Delta Aquarides", 7, 30, 25), ("Perséides", 8, 12, 100), ("Draconides", 10, 8, 10), ("Orionides", 10, 21, 20), ("Léonides", 11, 17, 15), ("Géminides", 12, 14, 150), ("Ursides", 12, 22, 10))


def day_of(moment: dt.datetime) -> float:
    """Day number of a moment, as the column function has it."""
    days = moment.toordinal() - dt.date(1999, 12, 31).toordinal()
    return days + (moment.hour + moment.minute / 60 + moment.second / 3600) / 24


def positions_at(objects: DataFrame, moment: dt.datetime, latitude: float, longitude: float) -> DataFrame:
    """objects (ra, dec) with alt, az and the altitude as refracted."""
    lst = A.sidereal(F.lit(day_of(moment)), longitude)
    out = objects.withColumn("_lst", lst)
    out = out.withColumns({"alt": A.altitude(F.col("_lst"), F.col("ra"), F.col("dec"), latitude), "az": A.azimuth(F.col("_lst"), F.col("ra"), F.col("dec"), latitude)})
    return out.withColumn("alt_refracted", F.col("alt") + A.refraction(F.col("alt"))).drop("_lst")


def search(objects: DataFrame, moment: dt.datetime, latitude: float, longitude: float, family: str | None = None, max_mag: float | None = None, min_altitude: float = 0.0, text: str = "", order: str = "altitude", limit: int = 400) -> DataFrame:
    """Objects by family, magnitude (unknown passes), text and altitude; cheap filters come before the ephemeris."""
    rows = objects
    if family:
        rows = rows.where(F.col("family") == family)
    if max_mag is not None:
        rows = rows.where(F.col("mag").isNull() | (F.col("mag") <= max_mag))
    if text:
        rows = rows.where(F.contains(F.lower("name"), F.lit(text.lower())))
    rows = positions_at(rows, moment, latitude, longitude)
    if min_altitude > 0:
        rows = rows.where(F.col("alt") >= min_altitude)
    keys = {"altitude": F.col("alt").desc(), "magnitude": F.coalesce("mag", F.lit(99.0)).asc(), "name": F.col("name").asc()}
    return rows.orderBy(keys[order], "object_id").limit(limit)


def highlights(objects: DataFrame, moment: dt.datetime, latitude: float, longitude: float, limit: int = 12) -> DataFrame:
    """Of the 400 highest objects over 15 degrees, the most interesting."""
    high = search(objects, moment, latitude, longitude, min_altitude=15.0)
    score = F.col("alt") / 90 - F.coalesce("mag", F.lit(8.0)) / 20 + F.when(F.col("kind_of_object") == "PROMO", 0.6).otherwise(0.0)
    return high.withColumn("score", score).orderBy(F.col("score").desc(), "object_id").limit(limit)


def rise_and_set(objects: DataFrame, day: dt.date, latitude: float, longitude: float, horizon: float = HORIZON) -> DataFrame:
    """Minutes after midnight UT of rising, setting and transit, and the extremes of altitude, for fixed positions.

    Altitudes are taken every STEP_MINUTES; each row holds its own and the one before, so first crossings are plain
    aggregates. Twelve bisections refine them.
    """
    start = day_of(dt.datetime(day.year, day.month, day.day))

    def alt_at(minute: Column) -> Column:
        return A.altitude(A.sidereal(F.lit(start) + minute / 1440, longitude), F.col("ra"), F.col("dec"), latitude)

    n = 24 * 60 // STEP_MINUTES
    # objects are dealt to tasks before their altitudes are taken, so that only they are shuffled and a task holds about AT_ONCE
    dealt = objects.select("object_id", "ra", "dec").repartition(max(1, objects.count() // AT_ONCE), "object_id", "ra", "dec")
    rows = dealt.select("object_id", "ra", "dec", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    rows = rows.withColumns({"m": F.col("k") * float(STEP_MINUTES), "alt": alt_at(F.col("k") * float(STEP_MINUTES)), "before": F.when(F.col("k") > 0, alt_at((F.col("k") - 1) * float(STEP_MINUTES)))})
    found = rows.groupBy("object_id", "ra", "dec").agg(
        F.min(F.when((F.col("before") < horizon) & (F.col("alt") >= horizon), F.col("m"))).alias("rise_after"),
        F.min(F.when((F.col("before") >= horizon) & (F.col("alt") < horizon), F.col("m"))).alias("set_after"),
        F.max("alt").alias("highest"),
        F.min("alt").alias("lowest"),
        F.max(F.coalesce(F.floor(F.col("alt") * 1e6 + 0.5), F.lit(-(10**9))) * 2048 + (1440 - F.col("k") * STEP_MINUTES)).alias("top"),  # the highest, then the earliest; numbers aggregate without a sort
    )

    def refined(end: Column, rising: bool) -> Column:
        begin = F.struct((end - STEP_MINUTES).alias("lo"), end.alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            low = (alt_at(mid) < horizon) if rising else (alt_at(mid) >= horizon)
            return F.when(low, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), begin, halve, lambda a: (a["lo"] + a["hi"]) / 2)

    return found.select(
        "object_id",
        half_up(refined(F.col("rise_after"), True), 2).alias("rise_minute"),
        half_up(refined(F.col("set_after"), False), 2).alias("set_minute"),
        (1440 - F.pmod("top", F.lit(2048))).cast("double").alias("transit_minute"),
        half_up(F.col("highest"), 6).alias("highest"),
        (F.col("lowest") > horizon).alias("always_up"),
        (F.col("highest") < horizon).alias("never_up"),
    )


def time_grid(spark: SparkSession, start: dt.datetime, hours: int, n: int) -> DataFrame:
    at = F.timestamp_add("HOUR", (F.col("i") * hours).cast("int"), F.lit(start).cast("timestamp_ntz"))
    return spark.range(0, n).select(F.col("id").alias("i"), at.alias("at")).withColumn("d", A.day_number(F.col("at")))


def _crossed(before: Column, now: Column, target: float) -> Column:
    def turn(v: Column) -> Column:
        return F.pmod(v - target + 0.5, F.lit(1.0)) - 0.5

    x, y = turn(before), turn(now)
    return (x < 0) & (y >= 0) & (F.abs(x) < 0.1) & (F.abs(y) < 0.1)


def upcoming_events(spark: SparkSession, start: dt.datetime, days: int = 120) -> DataFrame:
    """Lunar phases, seasons, oppositions, conjunctions and meteor showers: id, at, kind, title, rank."""
    n = days * 4
    grid = A.with_moon(A.with_sun(time_grid(spark, start, 6, n + 2)))
    planets = A.with_planets(grid.select("i", "at", "d", "sun_lon", "sun_dist", "sun_ra", "sun_dec"))
    day = F.date_format("at", "yyyy-MM-dd")

    def event(df: DataFrame, id_: Column, kind: str, title: Column, rank: Column) -> DataFrame:
        return df.select(id_.alias("id"), "at", F.lit(kind).alias("kind"), title.alias("title"), rank.alias("rank"))

    by_time = W.orderBy("i")
    seq = grid.withColumns({"phase0": F.lag("moon_phase").over(by_time), "sun0": F.lag("sun_lon").over(by_time)}).where((F.col("i") >= 1) & (F.col("i") <= n))
    out = [event(seq.where(_crossed(F.col("phase0"), F.col("moon_phase"), t)), F.concat(F.lit(f"moon-{label}-"), day), "lune", F.lit(label), F.lit(rank)) for t, label, rank in PHASES]
    out += [event(seq.where(_crossed(F.col("sun0") / 360, F.col("sun_lon") / 360, t / 360)), F.concat(F.lit(f"season-{t}-"), day), "saison", F.lit(label), F.lit(3)) for t, label in SEASONS]

    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    elong = planets.withColumn("elong", separation_deg(F.col("sun_ra"), F.col("sun_dec"), F.col("planet_ra"), F.col("planet_dec")))
    elong = elong.withColumn("elong0", F.lag("elong").over(W.partitionBy("planet").orderBy("i"))).where((F.col("i") >= 1) & (F.col("i") <= n))
    opposed = elong.where((F.col("elong0") < 178) & (F.col("elong") >= 178) & F.col("planet").isin("mars", "jupiter", "saturne", "uranus", "neptune"))
    out.append(event(opposed, F.concat(F.lit("opp-"), "planet", F.lit("-"), day), "planete", F.concat(F.lit("Opposition de "), label[F.col("planet")]), F.lit(1)))

    order = F.create_map(*(F.lit(x) for i, k in enumerate(LABELS) for x in (k, i)))
    bodies = planets.select("i", "at", F.col("planet").alias("body"), F.col("planet_ra").alias("ra"), F.col("planet_dec").alias("dec")).unionByName(grid.select("i", "at", F.lit("lune").alias("body"), F.col("moon_ra").alias("ra"), F.col("moon_dec").alias("dec")))
    bodies = bodies.withColumn("n", order[F.col("body")])
    a, b = bodies.alias("a"), bodies.drop("at").alias("b")
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.n") < F.col("b.n")))
    pairs = pairs.select("a.i", "at", F.col("a.body").alias("one"), F.col("b.body").alias("two"), separation_deg(F.col("a.ra"), F.col("a.dec"), F.col("b.ra"), F.col("b.dec")).alias("sep"))
    pair = W.partitionBy("one", "two").orderBy("i")
    near = pairs.withColumns({"sep0": F.lag("sep").over(pair), "sep2": F.lead("sep").over(pair)}).where((F.col("i") >= 1) & (F.col("i") <= n) & (F.col("sep") < 3) & (F.col("sep") < F.col("sep0")) & (F.col("sep2") > F.col("sep")))
    out.append(event(near, F.concat(F.lit("conj-"), "one", F.lit("-"), "two", F.lit("-"), day), "conjonction", F.concat(F.lit("Rapprochement "), label[F.col("one")], F.lit(" – "), label[F.col("two")]), F.when(F.col("sep") < 1, 1).otherwise(2)))

    falls = [(f"shower-{s}-{y}", dt.datetime(y, m, d, 2), f"Maximum des {s}", 1 if zhr >= 80 else 2) for y in (start.year, start.year + 1) for s, m, d, zhr in SHOWERS]
    falls = [x for x in falls if start < x[1] and (x[1] - start) < dt.timedelta(days=days)]
    showers = spark.createDataFrame(falls, "id string, at timestamp_ntz, title string, rank int")
    out.append(showers.select("id", "at", F.lit("meteores").alias("kind"), "title", "rank"))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("id").agg(F.min(F.struct("at", "kind", "title", "rank")).alias("e")).select("id", "e.*")
