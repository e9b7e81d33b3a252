"""Image quality policy: resolution classes, blockers, score and eligibility of an exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.maths import clamp, half_even, half_up


def resolution_class(arcsec_per_pixel: Column) -> Column:
    s = arcsec_per_pixel
    return F.when(s <= 0, None).when(s <= 1.5, "high-definition").when(s <= 3, "detailed").when(s <= 6, "wide-field").when(s <= 12, "discovery")


def qualified(metrics: DataFrame) -> DataFrame:
    """metrics with resolution_class, blockers (comma-joined, in the order of the rules), score and eligible.

    A flag that is null is not set: without a licence or trusted astrometry a frame is blocked. A measure that is null breaks
    no rule and earns nothing. Parts of the score and their sum are rounded half to even.
    """
    c = F.col
    trusted, product, licensed = (F.coalesce(c(n), F.lit(False)) for n in ("trusted_astrometry", "calibrated_science_product", "licence_accepted"))
    effective = F.greatest("pixel_scale_arcsec", "native_pixel_scale_arcsec")
    rules = [
        ("insufficient-reference-stars", ~trusted & (c("matched_stars") < 20)),
        ("wcs-error-too-high", ~trusted & (c("wcs_rms_px") >= 1.5)),
        ("insufficient-coverage", c("usable_coverage") < 0.7),
        ("poor-fwhm", c("fwhm_arcsec") >= F.when(product, 6.0).otherwise(2.5) * c("pixel_scale_arcsec")),
        ("excessive-eccentricity", c("eccentricity") >= 0.65),
        ("major-tracking-error", c("has_major_tracking_error")),
        ("dense-clouds", c("has_dense_clouds")),
        ("excessive-saturation", c("saturated_fraction") >= 0.02),
        ("black-clipping", c("clipped_black_fraction") >= 0.01),
        ("insufficient-signal", c("signal_to_noise") < 5),
        ("artificial-upscale", c("pixel_scale_arcsec") < c("native_pixel_scale_arcsec") * 0.75),
        ("duplicate-upload", c("duplicate_detected")),
        ("missing-licence", ~licensed),
        ("unsupported-resolution", resolution_class(effective).isNull()),
    ]
    blockers = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules))), ",")
    astrometry = F.when(trusted, 25.0).otherwise(clamp((c("matched_stars") - 20) / 60, 0.0, 1.0) * 10 + clamp((1.5 - c("wcs_rms_px")) / 1.5, 0.0, 1.0) * 15)
    sharpness = clamp((2.5 - c("fwhm_arcsec") / c("pixel_scale_arcsec")) / 2, 0.0, 1.0) * 14 + clamp((0.65 - c("eccentricity")) / 0.45, 0.0, 1.0) * 11
    signal = clamp((c("signal_to_noise") - 5) / 20, 0.0, 1.0) * 20
    dynamic = clamp((0.02 - c("saturated_fraction")) / 0.02, 0.0, 1.0) * 8 + clamp((0.01 - c("clipped_black_fraction")) / 0.01, 0.0, 1.0) * 7
    coverage = clamp((c("usable_coverage") - 0.7) / 0.3, 0.0, 1.0) * 10
    provenance = F.when(c("metadata_complete"), 5.0).otherwise(2.0)
    parts = sum((half_even(F.coalesce(p, F.lit(0.0)), 2) for p in (sharpness, signal, dynamic, coverage)), half_even(F.coalesce(astrometry, F.lit(0.0)), 2)) + provenance
    out = metrics.withColumns({"resolution_class": resolution_class(effective), "blockers": blockers, "score": half_even(half_up(parts, 4)).cast("int")})
    return out.withColumn("eligible", (c("score") >= 70) & (c("blockers") == ""))
