"""Ephemerides as columns: day numbers, sidereal time, Sun, Moon, planets, altitude and azimuth, rising and setting.

Low-precision orbital elements, good to a minute of arc or two. Functions take a DataFrame with a day-number column and add
columns step by step, so that no expression is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.maths import asind, atan2d, clamp, cosd, rev, sind

RAD = 57.29577951308232

#: Orbital elements (value, change a day) N, i, w, a, e, M, and the magnitude at unit distances.
PLANETS = {
    "mercure": ((48.3313, 3.24587e-5), (7.0047, 5.0e-8), (29.1241, 1.01444e-5), (0.387098, 0.0), (0.205635, 5.59e-10), (168.6562, 4.0923344368), -0.36),
    "venus": ((76.6799, 2.4659e-5), (3.3946, 2.75e-8), (54.891, 1.38374e-5), (0.72333, 0.0), (0.006773, -1.302e-9), (48.0052, 1.6021302244), -4.34),
    "mars": ((49.5574, 2.11081e-5), (1.8497, -1.78e-8), (286.5016, 2.92961e-5), (1.523688, 0.0), (0.093405, 2.516e-9), (18.6021, 0.5240207766), -1.51),
    "jupiter": ((100.4542, 2.76854e-5), (1.303, -1.557e-7), (273.8777, 1.64505e-5), (5.20256, 0.0), (0.048498, 4.469e-9), (19.895, 0.0830853001), -9.25),
    "saturne": ((113.6634, 2.3898e-5), (2.4886, -1.081e-7), (339.3939, 2.97661e-5), (9.55475, 0.0), (0.055546, -9.499e-9), (316.967, 0.0334442282), -9.0),
    "uranus": ((74.0005, 1.3978e-5), (0.7733, 1.9e-8), (96.6612, 3.0565e-5), (19.18171, -1.55e-8), (0.047318, 7.45e-9), (142.5905, 0.011725806), -7.15),
    "neptune": ((131.7806, 3.0173e-5), (1.77, -2.55e-7), (272.8461, -6.027e-6), (30.05826, 3.313e-8), (0.008606, 2.15e-9), (260.2471, 0.005995147), -6.9),
}


def day_number(ts: Column) -> Column:
    """Days since 2000 January 0.0 UT."""
    y, m = F.year(ts), F.month(ts)
    ut = F.hour(ts) + F.minute(ts) / 60 + F.extract(F.lit("SECOND"), ts).cast("double") / 3600
    return 367 * y - F.floor(7 * (y + F.floor((m + 9) / 12)) / 4) + F.floor(275 * m / 9) + F.day(ts) - 730530 + ut / 24


def julian_day(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp")) / 86400000 + 2440587.5


def obliquity(d: Column) -> Column:
    return 23.4393 - 3.563e-7 * d


def sidereal(d: Column, longitude: float) -> Column:
    """Local sidereal time in degrees. A day number's fraction is universal time."""
    gmst0 = rev(282.9404 + 4.70935e-5 * d + (356.047 + 0.9856002585 * d) + 180)
    return rev(gmst0 + (d - F.floor(d)) * 24 * 15.04107 + longitude)


def altitude(lst: Column, ra: Column, dec: Column, latitude: float) -> Column:
    ha = rev(lst - ra)
    return asind(sind(dec) * sind(F.lit(latitude)) + cosd(dec) * cosd(F.lit(latitude)) * cosd(ha))


def azimuth(lst: Column, ra: Column, dec: Column, latitude: float) -> Column:
    ha, la = rev(lst - ra), F.lit(latitude)
    return rev(atan2d(-sind(ha) * cosd(dec), sind(dec) * cosd(la) - cosd(dec) * sind(la) * cosd(ha)))


def refraction(alt: Column) -> Column:
    return F.when(alt < -1, 0.0).otherwise(0.0167 / F.tan((alt + 7.31 / (alt + 4.4)) / RAD))


def steps(df: DataFrame, *stages: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """Adds the columns of each stage in turn; a stage gets a function from names to columns."""
    for stage in stages:
        df = df.withColumns(stage(F.col))
    return df


def _equatorial(df: DataFrame, lon: str, lat: str | None, r: str, d: str, prefix: str) -> DataFrame:
    def plane(c):
        z = c(r) * sind(c(lat)) if lat else F.lit(0.0)
        flat = cosd(c(lat)) if lat else F.lit(1.0)
        x, y, ecl = c(r) * cosd(c(lon)) * flat, c(r) * sind(c(lon)) * flat, obliquity(c(d))
        return {"_x": x, "_y": y * cosd(ecl) - z * sind(ecl), "_z": y * sind(ecl) + z * cosd(ecl)}

    out = steps(df, plane, lambda c: {f"{prefix}_ra": rev(atan2d(c("_y"), c("_x"))), f"{prefix}_dec": asind(c("_z") / F.sqrt(c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z")))})
    return out.drop("_x", "_y", "_z")


def with_sun(df: DataFrame, d: str = "d") -> DataFrame:
    """Adds sun_lon, sun_dist, sun_ra, sun_dec."""
    out = steps(
        df,
        lambda c: {"_w": 282.9404 + 4.70935e-5 * c(d), "_e": 0.016709 - 1.151e-9 * c(d), "_m": rev(356.047 + 0.9856002585 * c(d))},
        lambda c: {"_ea": c("_m") + RAD * c("_e") * sind(c("_m")) * (1 + c("_e") * cosd(c("_m")))},
        lambda c: {"_xv": cosd(c("_ea")) - c("_e"), "_yv": F.sqrt(1 - c("_e") * c("_e")) * sind(c("_ea"))},
        lambda c: {"sun_lon": rev(atan2d(c("_yv"), c("_xv")) + c("_w")), "sun_dist": F.sqrt(c("_xv") * c("_xv") + c("_yv") * c("_yv"))},
    )
    return _equatorial(out.drop("_w", "_e", "_m", "_ea", "_xv", "_yv"), "sun_lon", None, "sun_dist", d, "sun")


def eccentric_anomaly(m: Column, e: Column) -> Column:
    """Newton steps for Kepler's equation in degrees, at most 12, until a step is under 1e-8."""
    start = F.struct((m + RAD * e * sind(m) * (1 + e * cosd(m))).alias("x"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        delta = (acc["x"] - RAD * e * sind(acc["x"]) - m) / (1 - e * cosd(acc["x"]))
        return F.when(acc["done"], acc).otherwise(F.struct((acc["x"] - delta).alias("x"), (F.abs(delta) < 1e-8).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda acc: acc["x"])


def _heliocentric(df: DataFrame) -> DataFrame:
    """From elements el_N, el_i, el_w, el_a, el_e, el_M to hx, hy, hz, hr."""
    out = steps(
        df,
        lambda c: {"_ea": eccentric_anomaly(c("el_M"), c("el_e"))},
        lambda c: {"_xv": c("el_a") * (cosd(c("_ea")) - c("el_e")), "_yv": c("el_a") * (F.sqrt(1 - c("el_e") * c("el_e")) * sind(c("_ea")))},
        lambda c: {"_l": atan2d(c("_yv"), c("_xv")) + c("el_w"), "hr": F.sqrt(c("_xv") * c("_xv") + c("_yv") * c("_yv"))},
        lambda c: {
            "hx": c("hr") * (cosd(c("el_N")) * cosd(c("_l")) - sind(c("el_N")) * sind(c("_l")) * cosd(c("el_i"))),
            "hy": c("hr") * (sind(c("el_N")) * cosd(c("_l")) + cosd(c("el_N")) * sind(c("_l")) * cosd(c("el_i"))),
            "hz": c("hr") * sind(c("_l")) * sind(c("el_i")),
        },
    )
    return out.drop("_ea", "_xv", "_yv", "_l", *(f"el_{n}" for n in ("N", "i", "w", "a", "e", "M")))


def with_moon(df: DataFrame, d: str = "d") -> DataFrame:
    """Adds moon_ra, moon_dec, moon_dist_km, moon_phase (0 new, 0.5 full) and moon_illumination; needs sun_lon."""
    out = df.withColumns({"el_N": rev(125.1228 - 0.0529538083 * F.col(d)), "el_i": F.lit(5.1454), "el_w": rev(318.0634 + 0.1643573223 * F.col(d)), "el_a": F.lit(60.2666), "el_e": F.lit(0.0549), "el_M": rev(115.3654 + 13.0649929509 * F.col(d))})
    out = out.withColumns({"_M": F.col("el_M"), "_N": F.col("el_N"), "_Lm": rev(F.col("el_N") + F.col("el_w") + F.col("el_M"))})
    out = steps(
        _heliocentric(out),
        lambda c: {"_r": F.sqrt(c("hx") * c("hx") + c("hy") * c("hy") + c("hz") * c("hz")), "_Ms": rev(356.047 + 0.9856002585 * c(d)), "_D": rev(c("_Lm") - c("sun_lon")), "_F": rev(c("_Lm") - c("_N"))},
        lambda c: {
            "_lon": rev(atan2d(c("hy"), c("hx"))) - 1.274 * sind(c("_M") - 2 * c("_D")) + 0.658 * sind(2 * c("_D")) - 0.186 * sind(c("_Ms")) - 0.059 * sind(2 * c("_M") - 2 * c("_D")) - 0.057 * sind(c("_M") - 2 * c("_D") + c("_Ms")) + 0.053 * sind(c("_M") + 2 * c("_D")) + 0.046 * sind(2 * c("_D") - c("_Ms")) + 0.041 * sind(c("_M") - c("_Ms")) - 0.035 * sind(c("_D")) - 0.031 * sind(c("_M") + c("_Ms")) - 0.015 * sind(2 * c("_F") - 2 * c("_D")) + 0.011 * sind(c("_M") - 4 * c("_D")),
            "_lat": asind(c("hz") / c("_r")) - 0.173 * sind(c("_F") - 2 * c("_D")) - 0.055 * sind(c("_M") - c("_F") - 2 * c("_D")) - 0.046 * sind(c("_M") + c("_F") - 2 * c("_D")) + 0.033 * sind(c("_F") + 2 * c("_D")) + 0.017 * sind(2 * c("_M") + c("_F")),
            "_dist": c("_r") - 0.58 * cosd(c("_M") - 2 * c("_D")) - 0.46 * cosd(2 * c("_D")),
        },
        lambda c: {"_elong": rev(c("_lon") - c("sun_lon")), "_lon": rev(c("_lon"))},
        lambda c: {"moon_dist_km": c("_dist") * 6371, "moon_phase": c("_elong") / 360, "moon_illumination": (1 + cosd(180 - c("_elong"))) / 2},
    )
    return _equatorial(out, "_lon", "_lat", "_dist", d, "moon").drop("_M", "_N", "_Lm", "_r", "_Ms", "_D", "_F", "_lon", "_lat", "_dist", "_elong", "hx", "hy", "hz", "hr")


def with_planets(df: DataFrame, d: str = "d") -> DataFrame:
    """A row for each planet: planet, planet_ra, planet_dec, planet_dist, magnitude; needs sun_lon and sun_dist."""
    names = ("N", "i", "w", "a", "e", "M")
    rows = F.array(*(F.struct(F.lit(p).alias("planet"), F.lit(v[-1]).alias("base"), *(F.struct(F.lit(x[0]).alias("at"), F.lit(x[1]).alias("rate")).alias(n) for n, x in zip(names, v[:-1], strict=True))) for p, v in PLANETS.items()))
    out = df.withColumn("_p", F.explode(rows)).withColumns({"planet": F.col("_p.planet"), "_base": F.col("_p.base"), **{f"el_{n}": F.col(f"_p.{n}.at") + F.col(f"_p.{n}.rate") * F.col(d) for n in names}}).drop("_p").withColumn("el_M", rev(F.col("el_M")))
    out = steps(
        _heliocentric(out),
        lambda c: {"hx": c("hx") + c("sun_dist") * cosd(c("sun_lon")), "hy": c("hy") + c("sun_dist") * sind(c("sun_lon"))},
        lambda c: {"planet_dist": F.sqrt(c("hx") * c("hx") + c("hy") * c("hy") + c("hz") * c("hz"))},
        lambda c: {"_lon": rev(atan2d(c("hy"), c("hx"))), "_lat": asind(c("hz") / c("planet_dist")), "_phase": F.acos(clamp((c("hr") * c("hr") + c("planet_dist") * c("planet_dist") - c("sun_dist") * c("sun_dist")) / (2 * c("hr") * c("planet_dist")), -1.0, 1.0)) * RAD},
        lambda c: {"magnitude": c("_base") + 5 * F.log10(c("hr") * c("planet_dist")) + 0.013 * c("_phase")},
    )
    return _equatorial(out, "_lon", "_lat", "planet_dist", d, "planet").drop("_lon", "_lat", "_phase", "_base", "hx", "hy", "hz", "hr")


def phase_name(phase: Column) -> Column:
    names = ("new", "waxing crescent", "first quarter", "waxing gibbous", "full", "waning gibbous", "last quarter", "waning crescent")
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(phase * 8 + 0.5) % 8 + 1).cast("int"))
