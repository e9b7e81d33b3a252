"""Small column functions: times, scales, progress, names of directions, safe paths and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.maths import clamp, half_up

#: The sixteen winds, from north by east.
CARDINALS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO")


def from_mjd(mjd: Column) -> Column:
    return F.timestamp_millis(F.floor((mjd - 40587) * 86400000 + 0.5).cast("bigint")).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def age_opacity(age_s: Column, span_s: float = 7200.0) -> Column:
    return F.greatest(F.lit(0.2), 1 - age_s / span_s)


def poll_delay_ms(active: Column, failures: Column) -> Column:
    """Longer after failures; 5 s while something goes on, else 30 s; a minute at most."""
    return F.least(F.lit(60000.0), F.when(active, 5000.0).otherwise(30000.0) * F.pow(F.lit(2.0), F.least(failures, F.lit(5)))).cast("bigint")


def retry_delay_s(attempts: Column) -> Column:
    return F.least(F.lit(900.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8)))).cast("bigint")


def native_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arc seconds a pixel; null without a focal length."""
    return F.when(focal_mm > 0, 206.265 * pixel_um / focal_mm)


def match_confidence(matched: Column, rms_px: Column) -> Column:
    return clamp(F.least(matched / 40, F.lit(1.0)) * F.greatest(F.lit(0.0), 1 - rms_px / 2), 0.0, 1.0)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(clamp(done * 100 / total, 0.0, 100.0))).otherwise(0.0).cast("int")


def cardinal(azimuth: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CARDINALS)), (F.floor(F.pmod(azimuth, F.lit(360.0)) / 22.5 + 0.5) % 16 + 1).cast("int"))


def safe_path(path: Column, prefix: str) -> Column:
    """Under the prefix, of plain characters, without empty, . or .. parts."""
    parts = F.split(path, "/", -1)
    return F.startswith(path, F.lit(prefix)) & path.rlike("^[A-Za-z0-9._/-]+$") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def coverage_flag(covered: Column, sources: Column, grid: Column) -> Column:
    return (covered < 0.995) | (sources < grid)


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; of a key in both, the right one's value."""
    only = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(only, right)
