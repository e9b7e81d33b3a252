"""URL filter with a weighted vocabulary, and explicit host/path rules in front of it.

An Aho-Corasick automaton finds every vocabulary term of a URL in one pass. A hit counts only between boundaries (no
ASCII letter or digit next to it). One strict term rejects; soft terms reject when several distinct ones are found. The
vocabulary is read from a file on the driver and shipped to the tasks as the automaton's words.

Null, empty and odd URLs: a null URL, or one without ``://``, has empty host and path; its terms still count (null has
none). Repeated rows are judged alike. Other columns stay as they are, except that the operator's own result columns
replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from importlib.resources import files
from importlib.resources.abc import Traversable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import LOWER, UPPER, ascii_lower, shielding

#: Beside this module, also where the package is shipped as a zip.
TERMS_FILE = files(__package__) / "url_terms.txt"


def terms(file: Traversable = TERMS_FILE) -> dict[str, tuple[str, ...]]:
    """Terms by section ([strict], [soft]) of a vocabulary file: words between white space, lines from # left out."""
    out: dict[str, tuple[str, ...]] = {}
    section = ""
    for line in file.read_text("utf-8").splitlines():
        if line.startswith("["):
            section = line.strip("[]")
        elif not line.startswith("#"):
            out[section] = out.get(section, ()) + tuple(line.split())
    return out


STRICT, SOFT = (terms()[section] for section in ("strict", "soft"))
SOFT_NEEDED = 2
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

_TO_LOWER = str.maketrans(UPPER, LOWER)


def automaton(weights: dict[str, str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, kind in weights.items():
        out.add_word(term, (term, kind))
    out.make_automaton()
    return out


def hits(machine: ahocorasick.Automaton, url: str | None) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms of a URL that stand between boundaries."""
    if not url:
        return [], []
    text = url.translate(_TO_LOWER)
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (term, kind) in machine.iter(text):
        before, after = end - len(term), end + 1
        if (before < 0 or text[before] not in ALNUM) and (after == len(text) or text[after] not in ALNUM):
            found[kind].add(term)
    return sorted(found["strict"]), sorted(found["soft"])


def vocabulary_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct(strict, soft): the distinct terms found, each list sorted."""
    weights = {t: "soft" for t in soft} | {t: "strict" for t in strict}

    @F.pandas_udf("strict array<string>, soft array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(weights)
        for urls in batches:
            yield pd.DataFrame([hits(machine, u) for u in urls], columns=["strict", "soft"])

    return scan(url)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from behind the first :// to the next /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(length, host_length, rule, verdict) of the longest rule that fits, else null. rules: (verdict, "host/path")."""
    if not rules:
        return F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    rows = F.array(*(
        F.struct(F.lit(len(r)).alias("length"), F.lit(r.index("/")).alias("host_length"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r[: r.index("/")]).alias("host"), F.lit(r[r.index("/") :]).alias("path"))
        for v, r in rules
    ))
    fits = F.filter(rows, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, best)


@shielding("__url_hits", "__url_rule")
def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), and the terms found: strict_terms, soft_terms.

    A rule decides where one fits; else one strict term or soft_needed distinct soft terms block.
    """
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path, "__url_hits": vocabulary_hits(F.col(url), strict, soft)})
    out = out.withColumn("__url_rule", matching_rule(F.col("host"), F.col("path"), rules))
    block = (F.size("__url_hits.strict") > 0) | (F.size("__url_hits.soft") >= soft_needed)
    return out.withColumns({
        "rule": F.col("__url_rule.rule"),
        "verdict": F.coalesce(F.col("__url_rule.verdict"), F.when(block, "block").otherwise("allow")),
        "strict_terms": F.col("__url_hits.strict"),
        "soft_terms": F.col("__url_hits.soft"),
    }).drop("__url_hits", "__url_rule")
