"""Best-fit packing of tokenised documents into fixed-length sequences by the sum-of-squares rule.

A document's tokens and one end token are cut into pieces only where they exceed a sequence. Pieces are then dealt into
groups of about GROUP documents by a hash of the piece (id, number, content, and which of its equals it is in its task, so
that ids and rows that repeat very often spread over the groups), and each group is packed in one pass: a piece goes where the sum over
all residual gaps of the squared number of open sequences with that gap becomes smallest. What is shuffled and packed is
lengths and ids, never texts. A group leaves a handful of sequences not full, so larger groups waste less.

Null text is empty, and an empty document is its end token alone. Rows that repeat an id are packed as documents of their
own. Extra columns are not returned: the result has one row a piece. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import pieces, span_hashes

LENGTH, END_ID = 2048, 0
GROUP = 8192
CACHE_WORDS = 200_000
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Texts of these characters alone are split by byte classes; others go through the tokenizer as they are.
_PLAIN = re.compile(r"[\t-\r -~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0xC2] = _SIGN
_CLASS[0xC3:0xC6] = _LETTER


def plain_tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of contractions ('s 't 're 've 'm 'll 'd), letter runs, single digits and sign runs in lower-cased plain text."""
    kind = _CLASS[buf]
    tail = np.flatnonzero((buf & 0xC0) == 0x80)
    kind[tail] = kind[tail - 1]
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    start = (kind != before) & (kind != 0) | (kind == _DIGIT)
    stop = np.concatenate([(kind != before)[1:] | (kind[:-1] == _DIGIT), [True]]) & (kind != 0)
    mark = np.flatnonzero((buf[:-2] == 0x27) & (before[:-2] != _SIGN))
    if len(mark):
        one, two = buf[mark + 1], buf[mark + 2]
        short = np.isin(one, list(b"stmd"))
        long = (one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        mark, size = mark[short | long], np.where(short, 2, 3)[short | long]
        stop[mark] = start[mark + 1] = False
        last = mark + size - 1
        stop[last] = True
        start[last + 1] = kind[last + 1] != 0
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What a tokenizer file must say for plain_tokens() to split as it does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_plainly(tokenizer_file: str) -> bool:
    """Whether the file is a byte-level BPE that normalises and splits as plain_tokens() does, with no added token but those with <|."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    same = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
    return same and model.get("type") == "BPE" and not model.get("dropout") and all("<|" in t["content"] for t in spec.get("added_tokens", ()))


class WordTokens:
    """Token ids of texts.

    With a lower-casing byte-level BPE that never looks across white space, contractions and runs of letters, digits or signs
    of plain texts are tokenised once and kept, about CACHE_WORDS at most; then the later half goes, since the runs met first are
    mostly the common ones. With any other tokenizer file all texts go through the library.
    """

    def __init__(self, tokenizer_file: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.plainly = splits_plainly(tokenizer_file)
        self.limit = cache_words
        self.alphabet = _byte_alphabet()
        self.known: dict[int, int] = {}  # hash of a run to its number
        self.offsets, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store, self.stored = np.zeros(1 << 18, np.uint32), 0

    def _forget(self) -> None:
        """Keeps the first runs, half of the limit, and gives back what the others took."""
        stay = min(len(self.known), self.limit // 2)
        self.known = dict(islice(self.known.items(), stay))
        self.stored = int(self.sizes[:stay].sum())
        self.offsets, self.sizes = np.resize(self.offsets[:stay], max(1 << 16, 2 * stay)), np.resize(self.sizes[:stay], max(1 << 16, 2 * stay))
        self.store = np.resize(self.store[: self.stored], max(1 << 18, 2 * self.stored))

    def _learn(self, key: int, run: bytes) -> int:
        ids = [t.id for t in self.model.tokenize(run.decode() if run.isascii() else run.decode("latin-1").translate(self.alphabet))]
        n = len(self.known)
        if n == len(self.sizes):
            self.offsets, self.sizes = np.resize(self.offsets, 2 * n), np.resize(self.sizes, 2 * n)
        if self.stored + len(ids) > len(self.store):
            self.store = np.resize(self.store, 2 * (self.stored + len(ids)))
        self.store[self.stored : self.stored + len(ids)] = ids
        self.offsets[n], self.sizes[n] = self.stored, len(ids)
        self.stored += len(ids)
        self.known[key] = n
        return n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if self.plainly and "<|" not in t and _PLAIN.fullmatch(t)]
        odd = sorted(set(range(len(texts))).difference(plain))
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i, got in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, np.uint32)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i].lower().encode() for i in plain]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b" ".join(texts) + b"   "
        buf = np.frombuffer(joined, np.uint8)
        starts, stops = plain_tokens(buf)
        codes, found = pd.factorize(span_hashes(buf, starts, stops))
        if len(self.known) + len(found) > self.limit:
            self._forget()
        where = np.empty(len(found), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        numbers = np.empty(len(found), np.int64)
        for n, key in enumerate(found.tolist()):
            got = self.known.get(key)
            numbers[n] = self._learn(key, joined[starts[where[n]] : stops[where[n]]]) if got is None else got
        runs = numbers[codes]
        sizes = self.sizes[runs]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.store[np.repeat(self.offsets[runs] - upto[:-1], sizes) + np.arange(upto[-1])]
        ends = np.cumsum([len(x) + 1 for x in texts])
        cut = np.concatenate([[0], upto[np.searchsorted(starts, ends)]])
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_OF_PROCESS: dict[str, WordTokens] = {}


def word_tokens(tokenizer_file: str) -> WordTokens:
    """One for each worker process, so that what is known lasts over tasks."""
    if tokenizer_file not in _OF_PROCESS:
        _OF_PROCESS[tokenizer_file] = WordTokens(tokenizer_file)
    return _OF_PROCESS[tokenizer_file]


def tokenised(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and copy, which numbers equal pieces of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_file)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        copies: Counter[tuple] = Counter()
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode([t.decode() for t in texts]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), length)):
                        cut = ids[at : at + length]
                        crc = zlib.crc32(cut.tobytes())
                        out.append((doc_id, n, at, len(cut), crc, copies[doc_id, n, crc]))
                        copies[doc_id, n, crc] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{_SCHEMA}, copy int")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the order given.

    opened[g] is the number of open sequences with gap g. Moving one from gap g to g - s changes the sum of squares by
    2 * (opened[g - s] - opened[g]) + 2; a new sequence counts only the gap that it leaves. Among equals the smallest gap wins.
    """
    opened = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(map(int, lengths)):
        left = opened[: capacity - size + 1].copy()
        left[0] = 0  # full sequences are closed and cost nothing
        cost = 2 * (left - opened[size:]) + 2
        cost[0] -= 1  # closing a sequence leaves no gap behind
        cost[opened[size:] == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin())
        fresh = 2 * opened[capacity - size] + 1 if size < capacity else 0
        if size == capacity or opened[size + best] == 0 or fresh < cost[best] and not opened[size]:
            gap, chosen = capacity, made
            made += 1
        else:
            gap = size + best
            chosen = stacks[gap].pop()
            opened[gap] -= 1
        sequence[i], offset[i] = chosen, capacity - gap
        if gap > size:
            opened[gap - size] += 1
            stacks[gap - size].append(chosen)
    return sequence, offset


def pack(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group))
    parts = tokenised(docs, tokenizer_file, text, key, length, end_id).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = pdf["_group"].to_numpy() * (1 << 32) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns=["_group", "copy"])

    return parts.groupBy("_group").applyInPandas(place, f"{_SCHEMA}, sequence_id long, offset long")
