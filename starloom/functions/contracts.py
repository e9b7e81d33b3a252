"""Rules that rows must keep: uploads, owners, paths, addresses, archive products and pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EXTENSIONS = ("fit", "fits", "fts", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "dng", "tif", "tiff", "png", "jpg", "jpeg")
LICENCES = ("CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")
KINDS = ("light", "dark", "flat", "bias")
MOST_BYTES = 5 * 1024**3
COPYRIGHTED_MARKERS = ("dss", "digitized sky survey", "gsc", "guide star")
PUBLIC_RIGHTS = ("public", "released", "open", "unrestricted")
PRIVATE_RIGHTS = ("proprietary", "exclusive", "embargoed", "private", "restricted")
SUBGROUP_RANK = {"DRC": 0, "DRZ": 1, "DLC": 2, "FLC": 3, "FLT": 4}
ACTIVE_RUNS, ACTIVE_BUILDS = ("discovering", "downloading", "qualifying", "building"), ("building", "verifying")
SHA256 = "^[0-9a-f]{64}$"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold, comma-joined in their order; a rule that is null doesn't hold."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))), ",")


def optional(value: Column, ok: Column) -> Column:
    return value.isNull() | ok


def extension(name: Column) -> Column:
    """What stands behind the last dot, lower-cased; without a dot the whole name."""
    return F.lower(F.substring_index(name, ".", -1))


def upload_rules(c=F.col) -> dict[str, Column]:
    """Metadata of an upload, field by field."""
    span = lambda name, low, high, open_=False: optional(c(name), ((c(name) > low) if open_ else (c(name) >= low)) & (c(name) <= high))
    return {
        "filename": F.length(c("filename")).between(1, 255),
        "size_bytes": (c("size_bytes") > 0) & (c("size_bytes") <= MOST_BYTES),
        "object_id": F.length(c("object_id")).between(1, 50),
        "kind": c("kind").isin(*KINDS),
        "licence": c("licence").isin(*LICENCES),
        "focal_length_mm": span("focal_length_mm", 0, 100_000, True),
        "pixel_size_um": span("pixel_size_um", 0, 100, True),
        "exposure_s": span("exposure_s", 0, 86_400, True),
        "gain": span("gain", 0, 1_000_000),
        "temperature_c": span("temperature_c", -273.15, 200),
        "binning": span("binning", 1, 8),
        "latitude": span("latitude", -90, 90),
        "longitude": span("longitude", -180, 180),
    }


def acceptable_file(name: Column, size: Column) -> Column:
    return extension(name).isin(*EXTENSIONS) & (size > 0) & (size <= MOST_BYTES)


def passes_vision(generated: Column, confidence: Column) -> Column:
    """Unless a picture is thought to be generated with a confidence over 0.65; what is unknown passes."""
    return ~F.coalesce(generated & (confidence > 0.65), F.lit(False))


def owner_agrees(source_kind: Column, user: Column, item: Column) -> Column:
    """A community row has a user and no archive item, an archive row an item and no user."""
    return ((source_kind == "community") & user.isNotNull() & item.isNull()) | ((source_kind == "public_archive") & user.isNull() & item.isNotNull())


def has_target(object_id: Column, query: Column, keys: tuple[str, ...] = ("seed_order", "seed_index")) -> Column:
    """A run names an object, or its JSON query has all keys of a seed cell."""
    every = F.lit(True)
    for key in keys:
        every = every & F.get_json_object(query, f"$.{key}").isNotNull()
    return object_id.isNotNull() | F.coalesce(every, F.lit(False))


def master_path_fits(path: Column, object_id: Column, generation: Column) -> Column:
    """masters/{object}/..., or masters/{object}-.../{generation}/...; objects in any case."""
    parts, own = F.split(path, "/", -1), F.lower(object_id)
    scope = F.get(parts, F.lit(1))
    classic = F.lower(scope) == own
    scoped = F.startswith(scope, F.concat(own, F.lit("-"))) & (F.get(parts, F.lit(2)) == generation.cast("string")) & (F.size(parts) >= 4)
    return (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "masters") & (scope != "") & (classic | scoped)


def derivative_url(base: Column, path: Column, prefix: str, ending: str) -> Column:
    """Public address of a derived file; null for an unsafe path."""
    parts = F.split(path, "/", -1)
    safe = F.startswith(path, F.lit(prefix)) & F.endswith(F.lower(path), F.lit(ending)) & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    # addresses keep ! ' ( ) * ~ as they are and write a blank as %20
    encode = lambda p: F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%21"), F.lit("!")), F.lit("%27"), F.lit("'")), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")), F.lit("%7E"), F.lit("~"))
    return F.when(safe, F.concat(base, F.lit("/storage/v1/object/public/astro-derived/"), F.array_join(F.transform(parts, encode), "/")))


def published_tile(path: Column) -> Column:
    return F.coalesce(F.startswith(path, F.lit("hips/")) & F.endswith(path, F.lit(".webp")) & ~F.contains(path, F.lit("..")), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256), F.lit(False))


def trusted_archive(source_kind: Column, item: Column, sources: list[Column], records: list[Column], product: Column, source: str = "mast-ps1") -> Column:
    """An archive row whose source, record hash and product type are those of a trusted survey."""
    any_of = lambda tests: F.exists(F.array(*tests), lambda x: F.coalesce(x, F.lit(False)))
    hexes = [r.rlike("^[0-9a-fA-F]{64}$") for r in records]
    return F.coalesce(source_kind == "public_archive", F.lit(False)) & item.isNotNull() & any_of([s == source for s in sources]) & any_of(hexes) & F.coalesce(product == "stack-cutout", F.lit(False))


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, and one of the hosts, in any case."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce((scheme == "https") & host.isin(*hosts), F.lit(False))


def is_public(rights: Column) -> Column:
    r = F.lower(F.trim(rights))
    private = F.lit(False)
    for word in PRIVATE_RIGHTS:
        private = private | F.contains(r, F.lit(word))
    return F.coalesce(~private & (r.isin(*PUBLIC_RIGHTS) | F.startswith(r, F.lit("public"))), F.lit(False))


def redistributable(provider: Column, collection: Column, rights: Column) -> Column:
    """By provider: two need public rights, one takes a missing statement as public, others allow nothing; some collections never."""
    copyrighted = F.lit(False)
    for marker in COPYRIGHTED_MARKERS:
        copyrighted = copyrighted | F.contains(F.lower(collection), F.lit(marker))
    return F.when(copyrighted, False).when(provider.isin("eso", "mast"), is_public(rights)).when(provider == "irsa", rights.isNull() | is_public(rights)).otherwise(False)


def usable_product(filename: Column, product_type: Column, calibration: Column) -> Column:
    """A FITS science product that is calibrated as far as is known."""
    return F.coalesce(F.lower(filename).rlike(r"\.(fits|fits\.fz|fz)$") & (F.upper(product_type) == "SCIENCE"), F.lit(False)) & (calibration.isNull() | (calibration >= 2))


def subgroup_rank(subgroup: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in SUBGROUP_RANK.items() for x in kv))
    return F.coalesce(ranks[F.upper(subgroup)], F.lit(50))


def pointer_rules(c=F.col, schema: str = "pointer-v1", prefix: str = "hips/", most_order: int = 9) -> dict[str, Column]:
    """A publication pointer of ten fields, with the first that doesn't hold deciding."""
    safe = lambda name: F.startswith(c(name), F.lit(prefix)) & c(name).rlike("^[a-zA-Z0-9._/-]+$") & ~F.contains(c(name), F.lit("..")) & ~F.contains(c(name), F.lit("//")) & ~F.endswith(c(name), F.lit("/"))
    return {
        "schema": c("schema") == schema,
        "root_path": safe("root_path"),
        "manifest_path": safe("manifest_path"),
        "manifest_sha256": is_sha256(c("manifest_sha256")),
        "inventory_sha256": is_sha256(c("inventory_sha256")),
        "hipsgen_sha256": is_sha256(c("hipsgen_sha256")),
        "source_count": c("source_count") >= 1,
        "hips_order": c("hips_order").between(0, most_order),
        "hipsgen_version": F.length("hipsgen_version") >= 1,
        "spectral_filter": F.length("spectral_filter") >= 1,
    }


def is_active(active: Column, run_status: Column, build_status: Column) -> Column:
    """Whether something still goes on: active items, an open run, or an open build."""
    return F.coalesce(active > 0, F.lit(False)) | F.coalesce(run_status.isin(*ACTIVE_RUNS), F.lit(False)) | F.coalesce(build_status.isin(*ACTIVE_BUILDS), F.lit(False))


def cone_rules(ra: Column, dec: Column, radius: Column, most: Column) -> dict[str, Column]:
    return {"ra": (ra >= 0) & (ra < 360), "dec": dec.between(-90, 90), "radius": (radius > 0) & (radius <= 10), "records": most.between(1, 1000)}


def recoverable(status: Column, code: Column, detail: Column, reason: Column) -> Column:
    """Failures that a retry may heal: adapter and solver errors, too few pixels, or a rejection for an old reason."""
    tried = status.isin("failed", "extracting")
    cases = [tried & (code == "PROGRAMMINGERROR") & detail.like("cannot adapt type %dict%"), tried & (code == "CALLEDPROCESSERROR") & detail.like("%solve-field%"), (status == "failed") & (code == "VALUEERROR") & (detail == "too few finite image pixels"), (status == "rejected") & (reason == "poor-fwhm,dense-clouds")]
    out = F.lit(False)
    for case in cases:
        out = out | F.coalesce(case, F.lit(False))
    return out


def metrics_valid(c=F.col) -> Column:
    """Measured figures are finite and in their ranges; a native scale may be missing."""
    finite = lambda n: c(n).isNotNull() & ~F.isnan(c(n)) & (F.abs(c(n)) < float("inf"))
    names = ("matched_stars", "wcs_rms_px", "usable_coverage", "fwhm_arcsec", "pixel_scale_arcsec", "eccentricity", "saturated_fraction", "clipped_black_fraction", "signal_to_noise")
    every = F.lit(True)
    for n in names:
        every = every & finite(n) & (c(n) >= 0)
    shares = [c(n) <= 1 for n in ("usable_coverage", "eccentricity", "saturated_fraction", "clipped_black_fraction")]
    for s in shares:
        every = every & s
    native = c("native_pixel_scale_arcsec")
    return F.coalesce(every & (c("pixel_scale_arcsec") > 0) & (native.isNull() | (finite("native_pixel_scale_arcsec") & (native > 0))), F.lit(False))
