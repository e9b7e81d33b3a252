"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Templates are notices and single
paragraphs of licenses from a file, not whole licenses. A template of n words is looked for in blocks of a power of two of words, BLOCK at least and
2 n at least, each half a block behind the one before, so any passage of n words lies inside a block. The join finds every
block that holds at least CONTAINMENT of a template's distinct words:

- a first pass counts in how many documents of the corpus each template word stands; words are ordered by that, rarest
  first (only template words matter, so the order has as many entries as the templates have words);
- prefix filter: a block can only match if it holds one of the template's first ``n - needed + 1`` words in this order;
- length filter: and if it holds at least ``needed`` distinct template words;
- positional filter: a template is given up once the words that it has missed leave fewer than needed.

A notice of fewer than SHORT words is a phrase, and its words alone prove little. A block that holds enough of them must
also hold them in the notice's order and near each other: in a run of words a quarter longer than the notice, CONTAINMENT of
its distinct words stand in the order of the notice. Its containment is the share of those.

Null text is empty and has no words, no label and score 0. Very long texts are read whole, block by block. Repeated rows
are judged alike. Extra columns stay; result columns replace input columns of the same name. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from importlib.resources import files
from importlib.resources.abc import Traversable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import hashed_words, pieces

PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Beside this module, also where the package is shipped as a zip.
TEMPLATES_FILE = files(__package__) / "license_templates.txt"
BLOCK, CONTAINMENT, SHORT = 64, 0.9, 24


def templates_of(file: Traversable = TEMPLATES_FILE) -> tuple[tuple[str, str], ...]:
    """(label, words) of each text in a template file: words as in documents, joined by one space."""
    out: list[tuple[str, str]] = []
    for line in file.read_text("utf-8").splitlines():
        if line.startswith("["):
            out.append((line.strip("[]"), ""))
        elif line and not line.startswith("#"):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(b) for b in line.encode("latin-1").translate(_LOWER)))
            out[-1] = (out[-1][0], " ".join([*out[-1][1].split(), *words]))
    return tuple(out)


def block_of(words: str, least: int = BLOCK) -> int:
    """The size of the blocks in which a template is looked for: the power of two that is at least twice its words."""
    return max(least, 1 << (2 * len(words.split()) - 1).bit_length())


def run_of(words: str) -> int:
    """The length of the runs of words in which a short notice must stand; 0 for a longer text."""
    n = len(words.split())
    return n + n // 4 if n < SHORT else 0


_GAP = np.ones(256, bool)
_GAP[0x30:0x3A] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


TEMPLATES = templates_of()


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, first, _, _ = hashed_words([t.translate(_LOWER) for t in texts], _GAP)
    return hashes, first


def _numbered(vocabulary: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and for each the word's number."""
    hashes, _ = _words([w.encode() for w in vocabulary])
    order = np.argsort(hashes)
    return hashes[order], order


def _numbers(hashes: np.ndarray, keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The vocabulary number of each word, or -1."""
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, number[at], -1)


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many documents of the whole corpus each word of the (bounded) vocabulary stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = _numbered(vocabulary)
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                hashes, first = _words(texts)
                found = _numbers(hashes, keys, number)
                at = np.flatnonzero(found >= 0)
                doc = np.searchsorted(first, at, side="right")
                pairs = np.unique(doc * len(vocabulary) + found[at])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total)], ["word", "docs"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return dict.fromkeys(vocabulary, 0) | {vocabulary[r.word]: r.docs for r in counts}


class Templates:
    """Template word sets in the global order, with an index of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[str, int], containment: float):
        self.order = sorted(frequency, key=lambda w: (frequency[w], w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({rank[w] for w in words.split()}) for _, words in templates]
        self.runs = [run_of(words) for _, words in templates]
        self.places = [{rank[w]: i for i, w in enumerate(dict.fromkeys(words.split()))} for _, words in templates]
        self.needed = [max(1, int(np.ceil(containment * len(s) - 1e-9))) for s in self.sets]
        self.index: dict[int, list[int]] = {}
        for t, words in enumerate(self.sets):
            for w in words[: len(words) - self.needed[t] + 1]:
                self.index.setdefault(w, []).append(t)
        self.least = min(self.needed, default=1)

    def in_order(self, t: int, block: list[int]) -> float:
        """The largest share of a short notice's distinct words that stand in its order in one run of the block."""
        at = [(i, self.places[t][w]) for i, w in enumerate(block) if w in self.places[t]]
        most = 0
        for k, (start, _) in enumerate(at):
            ends: list[int] = []  # of the longest rising sequences of places
            for i, place in at[k:]:
                if i >= start + self.runs[t]:
                    break
                j = bisect_left(ends, place)
                ends[j : j + 1] = [place]
            most = max(most, len(ends))
        return most / len(self.places[t])

    def found(self, block: list[int]) -> dict[int, float]:
        """Containment of each template that a block, given as word ranks in order, holds: short notices in their order."""
        out = {}
        for t, share in self.contained(set(block) - {-1}).items():
            share = self.in_order(t, block) if self.runs[t] else share
            if share * len(self.sets[t]) >= self.needed[t] - 1e-9:
                out[t] = share
        return out

    def contained(self, block: set[int]) -> dict[int, float]:
        """Containment of each template that reaches the threshold in the block's set of word ranks."""
        out = {}
        if len(block) < self.least:
            return out
        for t in {t for w in block for t in self.index.get(w, ())}:
            words, may_miss = self.sets[t], len(self.sets[t]) - self.needed[t]
            if len(block) < self.needed[t]:
                continue
            missed = 0
            for w in words:
                missed += w not in block
                if missed > may_miss:
                    break
            else:
                out[t] = (len(words) - missed) / len(words)
        return out


def _matching_blocks(ranks: np.ndarray, first: np.ndarray, known: Templates, size: int) -> Iterator[tuple[int, dict]]:
    """(document, block) for each block of this size that holds enough of a template. ranks: of all words; first: of each document."""
    rare = np.zeros(len(known.order) + 1, bool)
    rare[list(known.index)] = True
    hit = np.flatnonzero(rare[ranks])
    doc = np.searchsorted(first, hit, side="right") - 1
    half = size // 2
    at = (hit - first[doc]) // half
    wanted = np.unique(np.stack([np.concatenate([doc, doc[at > 0]]), np.concatenate([at, at[at > 0] - 1])]), axis=1)
    for d, b in wanted.T.tolist():
        start = int(first[d]) + b * half
        inside = ranks[start : min(start + size, int(first[d + 1]))].tolist()
        for t, c in sorted(known.found(inside).items()):
            yield d, {"start": b * half, "label": known.labels[t], "containment": c}


def scan_licenses(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, block: int = BLOCK, containment: float = CONTAINMENT) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks: array of (start, label, containment)."""
    result = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())]))),
    ])
    docs = docs.drop(*(set(result.names) - {text}))
    vocabulary = sorted({w for _, words in templates for w in words.split()})
    frequency = document_frequencies(docs, vocabulary, text)
    by_size = {size: Templates([t for t in templates if block_of(t[1], block) == size], frequency, containment) for size in sorted({block_of(words, block) for _, words in templates})}
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = _numbered(order)
        wanted = [(label, _words([words.encode()])[0]) for label, words in phrases]
        for batch in batches:
            for part, texts in pieces(batch, text):
                hashes, first = _words(texts)
                places: dict[int, list[tuple[int, str]]] = {}
                for label, words in wanted:
                    at = np.flatnonzero(hashes == words[0])
                    at = at[at + len(words) <= len(hashes)]
                    for j in range(1, len(words)):
                        at = at[hashes[at + j] == words[j]]
                    doc = np.searchsorted(first, at, side="right") - 1
                    for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                        if i + len(words) <= first[d + 1]:
                            places.setdefault(d, []).append((i - int(first[d]), label))
                ranks = _numbers(hashes, keys, number)
                blocks_of: dict[int, list[dict]] = {}
                for size, known in by_size.items():
                    for d, found in _matching_blocks(ranks, first, known, size):
                        blocks_of.setdefault(d, []).append(found)
                rows = []
                for d in range(len(texts)):
                    n = int(first[d + 1] - first[d])
                    base = places.get(d, [])
                    blocks = blocks_of.get(d, [])
                    starts = [i for i, _ in base]
                    labels = sorted({x for _, x in base})
                    score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
                    rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted({*labels, *(b["label"] for b in blocks)})), score, blocks))
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *result.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *result.fields]))
