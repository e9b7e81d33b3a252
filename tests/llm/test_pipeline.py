import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import line_dedup, mixing, packing, quality
from starloom.llm.common import written
from tests.llm.test_operators import ODD, brute_classes, brute_measures, near_copies, prose


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packed.agg({"length": "sum"}).first()[0] == tokens


# run() against plain Python; a row is [doc_id, text, source]


def plain_quality(rows):
    judged = []
    for row in rows:
        words, chars, symbols, lines, twice, repeated = brute_measures(row[1])
        sy, dl, wl, rp = symbols / max(words, 1), twice / max(lines, 1), chars / max(words, 1), repeated / max(words, 1)
        base = words < quality.MIN_WORDS or 100 * repeated > quality.MAX_REPEAT_PERCENT * words
        bad = base or sy > quality.MAX_SYMBOLS_PER_WORD or dl > quality.MAX_DUP_LINES or rp > quality.MAX_REPEAT_SHARE or not quality.WORD_LENGTH[0] <= wl <= quality.WORD_LENGTH[1]
        severe = sy > quality.SEVERE_SYMBOLS_PER_WORD or dl > quality.SEVERE_DUP_LINES
        judged.append((row, base or severe, bad))
    n, b = Counter(r[2] for r, _, _ in judged), Counter(r[2] for r, _, bad in judged if bad)
    mean = b.total() / n.total()
    noise = mean * (1 - mean)
    between = (sum(n[h] * (b[h] / n[h] - mean) ** 2 for h in n) - noise * len(n)) / n.total()
    bad_hosts = set()
    if between > 0:
        strength = max(1.0, noise / between - 1)
        rate = {h: (b[h] + strength * mean) / (n[h] + strength) for h in n}
        z = {h: (rate[h] - 1.5 * mean) / math.sqrt(rate[h] * (1 - rate[h]) / (n[h] + strength + 1)) for h in n}
        error = {h: 1 / (1 + math.exp(1.5976 * z[h] + 0.07056 * z[h] ** 3)) for h in n}
        ranked = sorted(error, key=error.get)
        for k in range(1, len(ranked) + 1):  # as many as keep the mean error within 5 %
            if sum(error[h] for h in ranked[:k]) <= 0.05 * k:
                bad_hosts = set(ranked[:k])
    assert bad_hosts and any(bad and not gone and r[2] in bad_hosts for r, gone, bad in judged)  # hosts decide on some
    return [r for r, gone, bad in judged if not gone and not (bad and r[2] in bad_hosts)]


def plain_lines(rows):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text, _ in rows:
        for line in text.split("\n"):
            if len(key(line)) >= line_dedup.MIN_CHARS:
                holders[key(line)].add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= line_dedup.MIN_DOCS}
    return [[i, "\n".join(x for x in text.split("\n") if common.get(key(x), i) == i), source] for i, text, source in rows]


def plain_near(rows):
    keep = {min(map(int, group)) for group in brute_classes([(i, t) for i, t, _ in rows])}
    return [r for r in rows if r[0] in keep]


def plain_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((int(hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:15], 16), len(r[1].encode().split()), r))
    size = {s: sum(n for _, n, _ in by[s]) for s in sorted(by)}
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(size)}
    capped = set()
    while True:
        level = (sum(size.values()) - sum(mixing.CAP * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and level * weight[s] > mixing.CAP * size[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in size:
        target = mixing.CAP * size[s] if s in capped else level * weight[s]
        whole = int(target // size[s])
        left = target - whole * size[s]
        for _, n, r in sorted(by[s], key=lambda x: x[0]):
            out += [r] * (whole + (left >= n or 0 < left < n <= 2 * left))
            left -= n
    return out


def plain_pack(rows):
    encoder, length, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.LENGTH, []
    for i, text, _ in rows:
        ids = [*encoder.encode(text, add_special_tokens=False).ids, packing.END_ID]
        for n, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            pieces.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    opened, made, out = defaultdict(list), 0, []
    for piece in sorted(pieces, key=lambda p: (-p[3], p[0], p[1], p[4])):
        size = piece[3]

        def cost(gap, after=size):
            now = Counter({g: len(x) for g, x in opened.items()})
            if gap < length:
                now[gap] -= 1
            if gap > after:
                now[gap - after] += 1
            return sum(n * n for n in now.values())

        fits = [(cost(g), 0, g) for g in opened if opened[g] and g >= size]
        gap = min(fits + ([] if opened[size] else [(cost(length), 1, length)]))[2]
        chosen = made if gap == length else opened[gap].pop()
        made += gap == length
        if gap > size:
            opened[gap - size].append(chosen)
        out.append((*piece, chosen, length - gap))
    return out


PLAIN = [plain_quality, plain_lines, plain_near, plain_mix, plain_pack]


def corpus():
    common = "  This line stands in very many documents, indeed in most. "
    texts = [t for s in range(5) for t in near_copies(s, 120, 4, 1 + s % 3)] + [prose(500 + s, 60 + 4 * s) for s in range(45)] + [prose(7, 130)] * 3 + [prose(8, 2500)]
    texts = [t if i % 3 else f"{t}\n{common.upper() if i % 2 else common}\nshort line" for i, t in enumerate(texts)]
    texts += [prose(600 + s, 80) + " #" * (8 + s) for s in range(12)] + [prose(700 + s, 90) + " #" * 30 for s in range(2)] + ["too short", "", None, "a b c " * 60, "naïve café – 日本語 " + prose(9, 70)]
    return [[3 * i, t, "abbcccccdd"[i % 10] if " #" not in (t or "") else "de"[i % 2]] for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    ids, texts, sources = zip(*corpus(), strict=True)
    lengths = pa.array([len(t or "") for t in texts], pa.int64())
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": sources, "n_chars": lengths}), folder / "documents.parquet")
    return str(folder)


def test_run_equals_plain_python(spark, small):
    rows, sizes = corpus(), []
    for stage in PLAIN:
        before, rows = rows, stage(rows)
        assert rows != before  # each stage has something to do
        sizes.append(len(rows))
    assert sizes[0] < len(corpus()) and sizes[2] < sizes[1] and len({r[5] for r in rows}) > 1
    got = corpus_pipeline.run(spark, small).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert Counter(map(tuple, got.collect())) == Counter(rows)


def test_stages_equal_plain_python(spark, small):
    docs, rows = spark.read.parquet(f"{small}/documents.parquet"), corpus()
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], PLAIN, strict=False):
        docs, rows = written(stage(spark, docs, small), name.replace(" ", "-")), plain(rows)
        assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == Counter(map(tuple, rows)), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())


# each stage on odd, empty and clashing tables

CLASHING = sorted(mixing.ADDED | quality.ADDED | {"n_lines", "n_dropped", "__row1", "__once", "__copy", "bucket", "class_id", "keep"} - {"n_words"})


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in CLASHING}).repartition(3)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, clashing, stage):
    name, function = corpus_pipeline.STAGES[stage]
    before = clashing if stage < 3 else clashing.where("text is not null")
    got = function(spark, before, "").collect()
    assert got and list(got[0].asDict()) == before.columns
    for r in got:
        assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in CLASHING)
    if name == "line dedup":
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t, *_ in ODD)
    if name == "quality rules":
        assert {r.doc_id for r in got} <= {5, 6, 7, None} and {r.doc_id for r in got} >= {6}
    if name == "near-duplicates":
        assert len(got) == len(brute_classes([(i, t) for i, t, *_ in ODD]))


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables_and_without_n_chars(spark, clashing, stage):
    _, function = corpus_pipeline.STAGES[stage]
    assert function(spark, clashing.limit(0), "").count() == 0
    assert function(spark, clashing.drop("n_chars"), "").count() > 0


def test_packing_of_odd_rows(spark, clashing):
    got = corpus_pipeline.STAGES[4][1](spark, clashing, "").collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, *_ in ODD)
