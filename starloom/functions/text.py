"""Text normalisation, relevance of image titles, aliases, and small parsers."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _marked_letters() -> tuple[str, str]:
    """Latin letters that canonical decomposition turns into one plain letter and marks, and those letters."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and plain.isascii() and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(code), plain))
    return "".join(m for m, _ in pairs), "".join(p for _, p in pairs)


def _compatible_characters() -> tuple[str, str]:
    """Characters beyond ASCII that stand for one ASCII character by compatibility (full width, raised, circled), and that."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(c, n) for c, n in pairs if len(n) == 1 and n.isascii()]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


MARKED, PLAIN = _marked_letters()
COMPATIBLE, COMMON = _compatible_characters()
MARKS = "[\u0300-\u036f]"

#: What a title of an unwanted picture says.
BLOCKED = ("finder chart", "star chart", "constellation map", "sky map", "diagram", "schematic", "spectrum", "spectra", "spectrograph", "light curve", "logo", "icon", "illustration", "artist impression", "artist s impression", "simulation")


def normalise(text: Column) -> Column:
    """Marks removed, lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.translate(text, MARKED, PLAIN), MARKS, "")), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.replace(normalise(text), F.lit(" "), F.lit(""))


def is_relevant(title: Column, description: Column, terms: Sequence[str]) -> Column:
    """Whether a picture's text names one of the terms (catalogue numbers with or without a space) and nothing blocked."""
    hay = normalise(F.concat_ws(" ", title, description))
    dense = F.replace(hay, F.lit(" "), F.lit(""))
    blocked = F.lit(False)
    for term in BLOCKED:
        blocked = blocked | F.contains(hay, F.lit(term))
    named = F.lit(False)
    for term in terms:
        n, d = normalise(F.lit(term)), compact(F.lit(term))
        number = d.rlike(r"^(m|ngc|ic|c)\d+[a-z]?$")
        named = named | F.when(n == "", False).when(number, F.contains(dense, d)).otherwise(F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))
    return ~blocked & named


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " "))


def slug(text: Column) -> Column:
    return F.replace(normalise(text), F.lit(" "), F.lit("-"))


def safe_name(name: Column) -> Column:
    """Compatible characters as common ones, a letter with a mark as one letter, other runs as one hyphen; the last 180."""
    common = F.regexp_replace(F.translate(name, COMPATIBLE, COMMON), f"[A-Za-z]{MARKS}", "\u00e9")
    return F.right(F.regexp_replace(common, "[^a-zA-Z0-9._-]+", "-"), F.lit(180))


def aliases(designation: Column) -> Column:
    """'NGC 6960/6992' as both names; distinct, trimmed, not empty."""
    prefix = F.regexp_extract(designation, r"^([A-Za-z]+ )", 1)
    parts = F.transform(F.split(designation, "/"), lambda p: F.trim(F.when(p.rlike(r"^\s*\d"), F.concat(prefix, F.trim(p))).otherwise(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def properties(text: Column) -> Column:
    """'key = value' lines as a map; comments and other lines are left out, the last of a key wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.trim(x), F.lit("#")) & F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    last = F.filter(pairs, lambda p: p["k"] != "")
    return F.map_from_entries(last)


def topic(text: Column) -> Column:
    """The first rule that fits names the topic."""
    t = normalise(text)
    return F.when(t.rlike(r"\b(moon|lune|luna|mond)\b"), "moon").when(t.rlike(r"\b(sun|soleil|sol|sonne)\b"), "sun").when(t.rlike(r"\b(star|etoile|estrella|stern)\b"), "star").otherwise("other")


def truncated(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def mail_name(address: Column) -> Column:
    """What stands before the first @."""
    return F.substring_index(address, "@", 1)


def title(code: Column) -> Column:
    """'meteor_shower' as 'Meteor Shower'."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def repaired(text: Column, known: Column) -> Column:
    """The known text where a character was lost (U+FFFD), else the text as it is."""
    return F.when(F.contains(text, F.lit("\ufffd")), F.coalesce(known, text)).otherwise(text)


def instrument_group(provider: Column, facility: Column, instrument: Column, band: Column) -> Column:
    parts = (provider, F.coalesce(facility, F.lit("unknown-facility")), F.coalesce(instrument, F.lit("unknown-instrument")), band)
    return F.left(F.concat_ws(":", *(F.replace(F.lower(p), F.lit(" "), F.lit("-")) for p in parts)), F.lit(160))


def seed_slug(band: Column, order: Column, index: Column) -> Column:
    """Layer of a seed cell; null for an unknown band or a negative cell."""
    return F.when(band.rlike("^[grizy]$") & (order >= 0) & (index >= 0), F.concat(F.lit("sky-ps1-"), band, F.lit("-o"), order.cast("string"), F.lit("-"), index.cast("string")))


def parent_slug(object_id: Column, band: Column) -> Column:
    """Layer of an object's parents; null for an unknown band or an id without letters and digits."""
    name = F.lower(F.regexp_replace(object_id, r"[^\p{L}\p{N}]", ""))
    return F.when(band.rlike("^[grizy]$") & (name != ""), F.concat(F.lit("sky-ps1-"), band, F.lit("-parent-"), name))


def global_slug(band: Column) -> Column:
    return F.when(band.rlike("^[grizy]$"), F.concat(F.lit("sky-ps1-"), band, F.lit("-global-loworder")))


def properties_text(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Lines 'key = value', each ended; a null value leaves its line out."""
    return F.concat(F.concat_ws("\n", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k} = "), v)) for k, v in pairs)), F.lit("\n"))


def url_file_name(url: Column, record: Column) -> Column:
    """The last part of the address's path if it has a dot, else a name from the record's hash."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(F.contains(name, F.lit(".")), F.left(name, F.lit(240))).otherwise(F.concat(F.lit("archive-"), F.left(F.sha2(record, 256), F.lit(20)), F.lit(".fits")))


def relative_direction(azimuth: Column, heading: Column) -> Column:
    """Where something stands for someone who looks along a heading."""
    turn = F.pmod(azimuth - heading + 540.0, F.lit(360.0)) - 180.0
    size = F.abs(turn)
    side = F.when(turn > 0, "vers la droite").otherwise("vers la gauche")
    return F.when(size < 10, "droit devant vous").when(size > 150, "derrière vous (faites demi-tour)").otherwise(F.concat(F.floor(size + 0.5).cast("string"), F.lit("° "), side))


def pool_index(text: Column, size: int) -> Column:
    """A place in a pool by the hash h * 31 + code over the text's characters, modulo 2**32."""
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return (F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, code: (h * 31 + code) % 4294967296) % size).cast("int")


def routed(text: Column, rules: Sequence[tuple[str, str]], pool: Sequence[str]) -> Column:
    """The label of the first rule whose pattern is found, in any case; else one of the pool by the text's hash."""
    out = F.element_at(F.array(*map(F.lit, pool)), pool_index(text, len(pool)) + 1)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return out
