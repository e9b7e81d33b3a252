"""Each operator on odd tables, and against brute force where SQL can't express it."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import fingerprint, fm_index, licenses, line_dedup, mixing, near_dedup, packing, quality, sharding, substring_dedup, url_filter
from starloom.llm.common import hashed_words, written
from starloom.llm.oracles import URL_RULES as SQL_RULES
from starloom.llm.queries import URL_RULES
from starloom.sources.storage import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the moon rises over quiet hills while seven old boats drift past a lamp and nobody counts them because night is long".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


LONG = prose(99, 30_000)
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t\n ", "en", "a", 5),
    (4, "word", "en", None, 4),
    (5, prose(1, 80), "en", "a", 1),
    (5, prose(1, 80), "en", "a", 1),
    (5, prose(2, 80), "en", "b", 1),
    (None, prose(1, 80), "en", "b", 1),
    (None, None, "en", "b", 1),
    (6, LONG, "en", "a", len(LONG)),
    (7, prose(3, 40) + "\n" + prose(3, 40), "en", "a", 1),
    (8, "naïve café – 日本語 ΣΑΣ 'tis don't x <|endoftext|>", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with those that operators add."""
    names = ("size", "taken", "n_words", "n_lines", "n_dropped", "kept", "labels", "fingerprint", "shard", "_hash", "host_rate", "n_removed", "bucket", "target")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit(f"own {n}") for n in names}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [t or "" for _, t, *_ in ODD]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


# near-duplicates


def shingles(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and (a & b).total() / (a | b).total() >= 0.8):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def spark_classes(df):
    rows = near_dedup.classes(df).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r.class_id, r.n_docs)].append(str(r.doc_id))
    return rows, sorted(sorted(g) for g in groups.values())


def near_copies(seed, n_words, copies, edits):
    r = random.Random(seed)
    base = prose(seed, n_words).split()
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_brute_force(spark):
    bodies = [t for s in range(6) for t in near_copies(s, 120, 12, 1 + s % 3)] + [prose(1000 + s, 60) for s in range(20)] + [prose(7, 120)] * 3
    rows = list(enumerate(bodies))
    _, got = spark_classes(table(spark, [(i, t, "a") for i, t in rows]))
    assert got == brute_classes(rows)


def test_near_duplicates_with_a_hub_whose_copies_are_not_alike(spark):
    bodies = near_copies(5, 150, 60, 3)
    _, got = spark_classes(table(spark, [(i, t, "a") for i, t in enumerate(bodies)]))
    assert got == brute_classes(list(enumerate(bodies)))


def test_near_duplicates_by_weight(spark):
    """Repeated passages weigh as often as they stand: pairs that only the counts tell apart, both ways."""
    a, b = prose(31, 60), prose(32, 60)
    rows = [(1, f"{a} {b}"), (2, f"{a} {b} {b} {b}"), (3, f"{a} {a} {a} {a} {a} {a} " + prose(33, 40)), (4, f"{a} {a} {a} {a} {a} {a} " + prose(34, 40))]
    df = table(spark, [(i, t, "a") for i, t in rows])
    _, got = spark_classes(df)
    assert got == brute_classes(rows) == [["1"], ["2"], ["3", "4"]]
    plain = {r.doc_id: r.class_id for r in near_dedup.classes(df, weighted=False).collect()}
    assert plain == {1: 1, 2: 1, 3: 3, 4: 4}  # without weights it is the other way round


def test_prefix_join_with_salts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup.prefix_pairs, "__defaults__", (3,))
    bodies = near_copies(5, 150, 60, 3) + near_copies(6, 180, 20, 2)
    _, got = spark_classes(table(spark, [(i, t, "a") for i, t in enumerate(bodies)]))
    assert got == brute_classes(list(enumerate(bodies)))


def test_near_duplicates_on_odd_rows(odd, empty):
    rows, _ = spark_classes(odd)
    assert len(rows) == len(ODD)
    keep = Counter((r.class_id, r.n_docs) for r in rows if r.keep)  # id 5 has two texts, so two classes
    assert set(keep.values()) == {1} and set(keep) == {(r.class_id, r.n_docs) for r in rows}
    assert {r.class_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.n_docs for r in rows if r.doc_id == 2} == {4}
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(keep)
    assert near_dedup.classes(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(3)
    for changed in (0, 40, 200, 400):
        a = rng.integers(1, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([rng.integers(1, 2**63, changed, dtype=np.uint64), a[changed:]])
        w = rng.uniform(0.2, 4.0, 400) if weighted else np.ones(400)
        args = (w,) if weighted else ()
        agree = (near_dedup.dart_signature(a, *args) == near_dedup.dart_signature(b, *args)).mean()
        same = w[changed:].sum()
        assert abs(agree - same / (2 * w.sum() - same)) < 0.12


# sharding


def test_shards(spark, odd, empty, tmp_path):
    kept = sharding.shard_by_arrival(odd, f"file://{tmp_path}/a", arrivals=5, fan_in=2)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t, *_ in ODD)
    assert sharding.shard_by_arrival(empty, f"file://{tmp_path}/b").count() == 0


def test_manifest_versions_are_atomic(spark, tmp_path):
    docs = table(spark, [(i, f"t{i}", "a") for i in range(40)])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=3)
    for i in range(3):
        assert store.append(docs.where(f"doc_id % 3 = {i}")) == i + 1
    assert [r.rows for r in store.manifest()[1]] == [14, 13, 13]
    with pytest.raises(sharding.CommitConflict):
        store.commit(2, [])
    before = store.manifest()[1]
    assert store.compact(docs.schema) == 4 and len(store.manifest()[1]) == 1
    assert store.read_runs(before, docs.schema).count() == 40 == store.read(docs.schema).count()
    store.vacuum(retention_s=0)
    assert store.read(docs.schema).count() == 40 and store.compact(docs.schema) is None
    with pytest.raises(sharding.LostRun):
        store.publish([before[0]])


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    docs = table(spark, [(i, f"t{i}", "a") for i in range(60)])
    one, two = (sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2) for _ in range(2))
    waiting = two.stage(docs.where("doc_id < 10"))
    one.append(docs.where("doc_id between 10 and 19"))
    one.append(docs.where("doc_id between 20 and 29"))
    one.settle(docs.schema, retention_s=0)  # removes what it merged, not what waits for its commit
    two.publish(waiting)
    full = sharding.full_tier(two.manifest()[1], two.target_bytes, 2)
    merged = two.stage(two.read_runs(full, docs.schema).coalesce(1))
    one.settle(docs.schema, retention_s=0)  # wins
    assert two._publish_change(lambda runs: [*(r for r in runs if r not in full), *merged] if set(full) <= set(runs) else None) is None
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: sharding.ShardStore(spark, f"file://{tmp_path}/s").append(docs.where(f"doc_id between {10 * i} and {10 * i + 9}")), (3, 4, 5)))
    assert sorted(r.doc_id for r in one.read(docs.schema).collect()) == list(range(60))
    assert sum(r.rows for r in one.manifest()[1]) == 60 and one.versions() == list(range(1, one.manifest()[0] + 1))


def test_vacuum_takes_leftovers_of_lost_writers_when_they_are_old(spark, tmp_path):
    docs = table(spark, [(i, f"t{i}", "a") for i in range(10)])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs)
    lost = store.stage(docs)[0]
    (tmp_path / "s" / "run-broken" / "_temporary" / "0").mkdir(parents=True)  # a writer lost in the middle
    store.vacuum()
    assert store.read_runs([lost], docs.schema).count() == 10
    store.vacuum(grace_s=0)
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("run-")] == [store.manifest()[1][0].name.partition("/")[0]]
    assert store.read(docs.schema).count() == 10


def test_tiers_against_a_plain_choice():
    r = random.Random(3)
    for _ in range(200):
        runs = [sharding.Run(str(i), 1, r.choice([10, 70_000, 300_000, 2_000_000, 9_000_000]), r.randrange(1, 4)) for i in range(r.randrange(12))]
        by = defaultdict(list)
        for x in runs:
            if x.bytes / x.files < 4_000_000 / 2:
                tier, limit = 0, 4 * (64 << 10)
                while x.bytes >= limit:
                    tier, limit = tier + 1, 4 * limit
                by[tier].append(x)
        want = next((by[t] for t in sorted(by) if len(by[t]) >= 3), [])
        assert sharding.full_tier(runs, 4_000_000, 3) == want


def test_merged_files_have_the_target_size(spark, tmp_path):
    docs = table(spark, [(i, prose(i, 300), "a") for i in range(400)]).repartition(8)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, fan_in=2)
    store.append(docs.where("doc_id % 2 = 0"))
    store.append(docs.where("doc_id % 2 = 1"))
    total = sum(r.bytes for r in store.manifest()[1])
    store.settle(docs.schema)
    (run,) = store.manifest()[1]
    assert run.files == round(total / 100_000) and 50_000 < run.bytes / run.files < 200_000 and run.rows == 400


# URLs


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "HTTP://WWW.Example.COM/en/7?x#y": ("www.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://a.com/en/3": ("a.com", "/en/3", "com/en/", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "http://other.net/de/81": ("other.net", "/de/81", "net/de/", "allow"),
        "http://bet-win.org/": ("bet-win.org", "/", None, "block"),
        "http://sussex.org/bet": ("sussex.org", "/bet", None, "allow"),
        "http://a.b?q=1://c/d": ("a.b", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules=URL_RULES).collect()}
    assert got == cases
    assert url_filter.filter_urls(df.limit(0), rules=URL_RULES).count() == 0
    assert SQL_RULES == URL_RULES


# repeated passages


def brute_repeats(rows, window):
    seen = Counter()
    for t in rows:
        w = (t or "").encode().split()
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def passages():
    shared = prose(50, 60).split()
    out = []
    for i in range(30):
        w = prose(60 + i, 100).split()
        out.append(" ".join(w[: 3 * i] + shared[i % 7 : 45 + i % 13] + w[3 * i :]))
    return [*out, " ".join(["a"] * 100), " ".join(["b", "c"] * 60), prose(3, 34), prose(3, 35), prose(3, 36), None, "", out[4]]


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeats_against_brute_force(spark, hot):
    rows = passages()
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(table(spark, [(i, t, "a") for i, t in enumerate(rows)]), hot=hot, shard_words=700).collect()}
    assert [got[i] for i in range(len(rows))] == brute_repeats(rows, 35)


def test_repeats_on_odd_rows(odd, empty):
    got = substring_dedup.remove_repeats(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and set(odd.columns) <= set(got.columns)
    assert Counter((r.n_words, r.n_removed, r.text) for r in rows) == Counter(brute_repeats(texts(), 35))
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("stream_words", [40, 1 << 18])
def test_matching_statistics(monkeypatch, stream_words):
    """Of the indexed segments themselves, and of other texts with words that the index hasn't."""
    monkeypatch.setattr(fm_index, "STREAM_WORDS", stream_words)
    r = random.Random(5)
    segments = [[r.randrange(1, 4) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    weights = np.array([r.randrange(1, 3) for _ in segments])
    index = fm_index.FmIndex(np.array([x for s in segments for x in [*s, 0]]), weights)
    for streamed in (segments, [[r.randrange(1, 6) for _ in range(r.randrange(20))] for _ in range(30)]):
        got = index.matching_statistics(np.array([x for s in streamed for x in [*s, 0]]))
        at = 0
        for s in streamed:
            for i in range(len(s)):
                best = 0
                for n in range(1, len(s) - i + 1):
                    count = sum(w for o, w in zip(segments, weights, strict=True) for j in range(len(o) - n + 1) if o[j : j + n] == s[i : i + n])
                    if count < 2:
                        break
                    best = n
                assert got[at + i] == best
            at += len(s) + 1


def test_repeats_of_very_many_equal_rows(spark):
    rows = [prose(1, 60)] * 700 + [prose(2, 60) + " " + prose(1, 60)]
    got = substring_dedup.remove_repeats(table(spark, [(min(i, 1), t, "a") for i, t in enumerate(rows[:-1])] + [(9, rows[-1], "a")])).collect()
    assert Counter((r.n_words, r.n_removed, r.text) for r in got) == Counter(brute_repeats(rows, 35))


# mixing


def test_mix(spark, odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD)
    sizes = [len((t or "").encode().split()) for t in texts()]
    assert sum(r.size for r in got) == sum(sizes)
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in got)
    again = {(r.doc_id, r.text, r.source): r.taken for r in mixing.mix_sources(odd.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.source): r.taken for r in got}
    assert mixing.mix_sources(empty).count() == 0


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), s) for i, s in enumerate(["a"] * 20 + ["b"] * 400 + ["c"] * 300 + [None] * 5 + ["é"] * 200)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    size = {s: sum(r.size for r in by[s]) for s in by}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s])


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_tells_repeated_rows_apart(spark, doc_id):
    rows = [(doc_id, "one two three four", "a")] * 300 + [(i, prose(i, 9), "b") for i in range(40)] + [(doc_id, prose(1000 + i, 5), "c") for i in range(200)]
    got = mixing.mix_sources(table(spark, rows).repartition(5)).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = mixing.mix_sources(table(spark, rows[::-1]).repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in got) == Counter((r.doc_id, r.text, r.taken) for r in again)


def test_mix_of_many_sources_in_ranges(spark):
    r = random.Random(8)
    rows = [(i, prose(i, 1 + r.randrange(30)), f"s{r.randrange(150)}") for i in range(600)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    size, target = {x.source: x.source_size for x in got}, {x.source: x.target for x in got}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(size))}
    want = plain_targets(size, weight)
    assert all(target[s] == pytest.approx(want[s]) for s in size)


def plain_targets(size, weight):
    capped = set()
    while True:
        level = (sum(size.values()) - sum(mixing.CAP * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and level * weight[s] > mixing.CAP * size[s]}
        if not over:
            return {s: mixing.CAP * size[s] if s in capped else level * weight[s] for s in size}
        capped |= over


# lines


def test_lines(spark, odd, empty):
    common = "  This line stands in very many documents, indeed in most. "
    rows = [(i, f"{common if i % 2 else common.upper().strip()}\nown line number {i} which is also rather long, so long\nshort\n{common if i == 3 else ''}", "a") for i in range(12)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows), batches=5).collect()}
    assert [got[i].n_dropped for i in range(12)] == [1, 1, 1, 2] + [1] * 7 + [0]
    assert got[11].text == rows[11][1] and got[3].text == "own line number 3 which is also rather long, so long\nshort"
    few = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows[:4])).collect()}
    assert set(few.values()) == {0}
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ODD) and set(odd.columns) <= set(out.columns)
    assert {(r.n_lines, r.n_dropped) for r in out.where("doc_id in (1, 2)").collect()} == {(1, 0)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, enough=2, fan_in=2, buckets=4)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 100 - b) for k in range(b, b + 3)], "h1 long, h2 long, doc_id long"))
    assert len(runs.runs()) <= 3
    state = {r.h1: (r.n_docs, r.last_id) for r in runs.state().collect()}
    assert state[0] == (1, 100) and state[2] == (2, 100) and state[4] == (2, 98) and set(state) == set(range(7))
    runs.drop()
    assert not runs.runs() and not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_line_runs_merge_without_exchange_or_sort(spark):
    runs = line_dedup.LineRuns(spark, buckets=4)
    for b in range(2):
        runs.add(spark.range(50_000 * b, 100_000).selectExpr("id h1", "id h2", "id doc_id"))
    batch = spark.range(9).selectExpr("id h1", "id h2", "1L n_docs").repartition(4, "h1", "h2")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with line_dedup._sorted_buckets(spark):
            plan = runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # both of the batch alone
    runs.drop()


# quality


def brute_measures(text):
    words = (text or "").encode().split()
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_filter_writes_no_texts(spark):
    root = Path(shared_dir(spark).removeprefix("file://"))
    rows = [(i, prose(i, 400), f"s{i % 3}") for i in range(60)]
    held = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    before = held()
    assert quality.quality_filter(table(spark, rows)).count() == 60
    assert held() - before < sum(len(r[1]) for r in rows) / 10


def test_quality_measures(odd, empty):
    got = quality.measured(odd).collect()
    assert Counter(tuple(r[k] for k in quality.METRICS) for r in got) == Counter(map(brute_measures, texts()))
    assert quality.measured(empty).count() == 0 and quality.quality_filter(empty).count() == 0


def test_host_verdicts(spark, odd):
    good, mild = prose(1, 100), prose(2, 100) + " #" * 8
    rows = [(i, good if i % 10 else mild, "clean") for i in range(300)] + [(1000 + i, mild if i % 10 else good, "dirty") for i in range(100)]
    kept = {r.doc_id for r in quality.quality_filter(table(spark, rows)).collect()}
    assert kept >= {i for i, t, _ in rows if t == good}
    assert {i for i in range(0, 300, 10)} <= kept and not kept & {i for i, t, s in rows if s == "dirty" and t == mild}
    rows = [(100 * h + i, good if i % 10 else mild, f"host {h}") for h in range(10) for i in range(40)] + [(5000, mild, "new")]
    rates = {r.host: r for r in quality.host_rates(quality.judged(quality.measured(table(spark, rows)))).collect()}
    assert rates["new"].n_bad == 1 and rates["new"].rate < 0.12 and not any(r.bad_host for r in rates.values())  # one failure proves nothing
    assert 5000 in {r.doc_id for r in quality.quality_filter(table(spark, rows)).collect()}
    assert quality.quality_filter(odd).columns == odd.columns


def test_hosts_dealt_at_random_are_not_bad(spark):
    """The test tables deal documents to hosts at random, so nothing of it may hang on the host."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    table_ = written(quality.judged(quality.measured(docs).drop("text")), "judged")
    rates = quality.host_rates(table_)
    assert rates.where("bad_host").count() == 0 and rates.count() > 10


def host_table(spark, rates, seed):
    """(source, n_failed) of hosts that fail at these rates, with 30 to 400 documents each, drawn at random."""
    r = np.random.default_rng(seed)
    rows = [(f"h{h}", int(r.random() < rate)) for h, rate in enumerate(rates) for _ in range(r.integers(30, 400))]
    return spark.createDataFrame(rows, "source string, n_failed int")


@pytest.mark.parametrize("rate", [0.05, 0.3])
def test_alike_hosts_are_not_bad(spark, rate):
    flagged = [quality.host_rates(host_table(spark, [rate] * 120, seed)).where("bad_host").count() for seed in range(4)]
    assert sum(flagged) <= 2


@pytest.mark.parametrize("bad", [3, 12, 40])
def test_bad_hosts_are_found_among_alike_ones(spark, bad):
    rates = [0.45] * bad + [0.1] * 120
    found = {r.host for r in quality.host_rates(host_table(spark, rates, bad)).where("bad_host").collect()}
    right = {f"h{i}" for i in range(bad)} & found
    assert len(right) >= 0.9 * bad and len(found - right) <= max(1, 0.1 * len(found))


def test_columns_named_like_inner_ones_come_back(spark):
    """Every operator, on documents that have columns named like those that it uses inside."""
    rows = [(i, prose(i % 3, 60) + "\n" + prose(5, 20), "en", f"s{i % 2}", 5) for i in range(8)]
    names = ["__batch", "__run", "__arrival", "__line_hash", "__line_drop", "__line_id", "__line_row", "__mix_hash", "__mix_place", "__mix_plan", "__mix_under", "__mix_at", "__r1", "__r2", "__row1", "__row2", "__spots", "__once", "__url_hits", "__url_rule", "__host"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
    store = f"{written(docs, 'odd-names').inputFiles()[0].rpartition('/')[0]}-store"
    judged_ = quality.judged(quality.measured(docs))
    results = {
        "op1": near_dedup.drop_near_duplicates(docs),
        "op2": sharding.shard_by_arrival(docs, store),
        "op3": url_filter.filter_urls(docs.withColumn("url", F.lit("http://a.example/porn"))),
        "op4": substring_dedup.remove_repeats(docs),
        "op5": mixing.mix_sources(docs),
        "op6": line_dedup.dedup_lines(docs),
        "op7": quality.with_verdicts(judged_, quality.host_rates(judged_)),
        "op7 filter": quality.quality_filter(docs),
    }
    for name, out in results.items():
        got = out.select("doc_id", *names).collect()
        assert got or name == "op7 filter", name
        assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names), name


def test_mix_takes_the_same_rows_whatever_the_partitioning(spark):
    """Rows alike in id and text but not in another column: which of them are taken hangs on the whole row."""
    text = prose(1, 10)
    docs = spark.createDataFrame([(1, text, "en", "a", i) for i in range(50)] + [(2, prose(2, 200), "en", "b", 0)], SCHEMA)
    taken = [{r.n_chars for r in mixing.mix_sources(docs.repartition(n)).where("source = 'b' OR copies > 2").collect()} for n in (1, 3, 7)]
    some = [sorted((r.n_chars, r.copies) for r in mixing.mix_sources(docs.repartition(n, "n_chars"), weights=(1, 30)).collect()) for n in (1, 3, 7)]
    assert taken[0] == taken[1] == taken[2] and some[0] == some[1] == some[2]
    assert len({c for _, c in some[0]}) > 1


# licenses


def test_licenses(spark, odd, empty):
    cases = {
        "Released under the MIT License.": ("mit", 1),
        "x UNDER-THE MIT\nLICENSE y under the mit license": ("mit", 2),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", 1),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl-3", 0),
        "CC BY-NC": ("cc-by-nc", 1),
        "under the mitt license": ("", 0),
        prose(1, 300) + " redistribution and use in source and binary forms, with or without modification, are permitted " + prose(2, 300): ("bsd", 0),
        "Licença: this work (mine) is licensed under the GNU General Public License version 3 été": ("gpl-3", 0),
    }
    got = {r.text: (r.labels, r.n_base) for r in licenses.scan_licenses(table(spark, [(i, t, "a") for i, t in enumerate(cases)])).collect()}
    assert got == cases
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 and r.first_word is None for r in rows)
    assert licenses.scan_licenses(empty).count() == 0


def test_whole_license_texts(spark):
    """Each template between other words, at places that blocks don't begin at, with one word in twenty changed."""
    r = random.Random(4)
    cases = {}
    for label, words in licenses.TEMPLATES:
        w = [x if i % 20 else f"x{i}" for i, x in enumerate(words.split(), 1)]
        cases[prose(r.randrange(99), r.randrange(400)) + " " + " ".join(w) + " " + prose(r.randrange(99), r.randrange(90))] = label
    got = {x.text: x.labels.split(",") for x in licenses.scan_licenses(table(spark, [(i, t, "a") for i, t in enumerate(cases)])).collect()}
    assert all(label in got[t] for t, label in cases.items())


def test_containment_join_is_exact():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(str(i), " ".join(r.sample(vocabulary, r.randrange(2, 12)))) for i in range(20)]
    known = licenses.Templates(templates, {w: r.randrange(9) for w in vocabulary}, 0.7)
    for _ in range(300):
        block = set(r.sample(range(30), r.randrange(1, 25)))
        words = {known.order[i] for i in block}
        want = {t for t, (_, ws) in enumerate(templates) if len(words & set(ws.split())) >= math.ceil(0.7 * len(set(ws.split())) - 1e-9)}
        assert set(known.contained(block)) == want


# packing


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, odd, empty, length):
    file = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(file)
    got = packing.pack(odd, file, length=length, group=4).collect()
    want = Counter()
    for i, t, *_ in ODD:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            want[(i, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    assert packing.pack(empty, file).count() == 0


def test_packing_spreads_a_hot_id(spark):
    rows = [(None, prose(i, 9), "a") for i in range(60)] + [(7, prose(99, 9), "a")] * 60
    got = packing.pack(table(spark, rows).coalesce(2), public_tokenizers.path("word_bpe_49k.json"), group=10).collect()
    assert Counter(r.doc_id for r in got) == {None: 60, 7: 60}
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 30


def test_token_cache_keeps_the_first_runs_and_stays_small():
    file = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordTokens(file), Tokenizer.from_file(file)
    texts = [" ".join(f"{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10 % 10]}{'uvwxyzabcd'[n // 100 % 10]}{'efghijklmn'[n // 1000 % 10]}{'opqrstuvwx'[n // 10000 % 10]}{'yzabcdefgh'[n // 100000 % 10]}" for n in range(at, at + 50_000)) for at in range(0, 300_000, 50_000)]
    for text in texts:
        words.encode([text])
        assert len(words.known) <= 200_000
    first = set(islice(words.known, 50_000))
    for text in (texts[0][:70_000], texts[5][-70_000:]):
        assert words.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    fresh = packing.WordTokens(file)
    fresh.encode(texts[:1])
    assert first == set(fresh.known)  # the runs met first are still known


def test_tokens_equal_the_library():
    file = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordTokens(file, cache_words=500), Tokenizer.from_file(file)
    r = random.Random(1)
    odd = ["".join(r.choice("ab'sdtmrevl1 .\n¿éÉß–Σ") for _ in range(r.randrange(1, 30))) for _ in range(800)] + ["", "  ", "'s'd'll'", "<|endoftext|> a"]
    assert [list(map(int, x)) for x in words.encode(odd)] == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]


def test_other_tokenizers_go_through_the_library(tmp_path):
    assert packing.splits_plainly(public_tokenizers.path("word_bpe_49k.json"))
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.splits_plainly(file)
    texts_ = ["Hello THERE, it's 2024 again", "  two  spaces ", "x"]
    assert [list(map(int, x)) for x in packing.WordTokens(file).encode(texts_)] == [x.ids for x in Tokenizer.from_file(file).encode_batch(texts_, add_special_tokens=False)]


def test_sum_of_squares_choices():
    """Against a plain search over all open sequences."""
    r = random.Random(4)
    sizes = [r.randrange(1, 33) for _ in range(300)]
    opened, placed = Counter(), []
    for s in sizes:
        def cost(gap, after=s):
            now = Counter(opened)
            if gap < 32:
                now[gap] -= 1
            if gap > after:
                now[gap - after] += 1
            return sum(n * n for n in now.values())
        fits = sorted(g for g in opened if opened[g] and g >= s)
        best = min([(cost(g), 0, g) for g in fits] + ([(cost(32), 1, 32)] if not opened[s] else []))[2]
        if best < 32:
            opened[best] -= 1
        if best > s:
            opened[best - s] += 1
        placed.append(32 - best)
    assert list(packing.sum_of_squares(np.array(sizes), 32)[1]) == placed


# fingerprints


def test_fingerprints(spark, odd, empty):
    rows = fingerprint.compared_to_next(odd).collect()
    assert len(rows) == len(ODD)
    order = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        want[(i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert fingerprint.compared_to_next(empty).count() == 0
    assert fingerprint.with_fingerprint(odd).where("text is null and fingerprint = ''").count() == 2


@pytest.mark.parametrize("range_bytes", [300, 20_000])
def test_ranges_hold_neighbours(spark, range_bytes):
    rows = [(5 * i % 211, prose(i, 3 + i % 40)) for i in range(120)] + [(None, "no id"), (None, "none either")]
    got = fingerprint.compared_to_next(table(spark, [(i, t, "a") for i, t in rows]), range_bytes=range_bytes).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter((i, hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def plain_syncmers(text):
    """Places whose k-mer has its smallest s-mer hash at its first or last place, by a loop over s-mers hashed one by one."""
    hash_ = {}
    for i in range(len(text) - fingerprint.S + 1):
        s = text[i : i + fingerprint.S]
        if s not in hash_:
            hash_[s] = int(fingerprint.hashes_of_s_mers(np.frombuffer(s.encode("utf-32-le"), np.uint32))[0])
    out = []
    for i in range(len(text) - fingerprint.K + 1):
        inner = [hash_[text[i + j : i + j + fingerprint.S]] for j in range(fingerprint.K - fingerprint.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_closed_syncmers_against_a_plain_loop():
    for t in (prose(1, 300), "abcdefghij" * 30, "x" * 100, "é日本" * 40, "short"):
        assert fingerprint.closed_syncmers(np.frombuffer(t.encode("utf-32-le"), np.uint32))[1].tolist() == plain_syncmers(t)


def test_likeness():
    a, b = prose(1, 400), prose(2, 400)
    mark = fingerprint.fingerprint
    assert fingerprint.likeness(mark(a), mark(a)) == 1.0 and fingerprint.likeness(mark(a), mark(b)) < 0.1
    assert fingerprint.likeness(mark(a), mark(fingerprint.edited(a, b))) > 0.3
    assert fingerprint.likeness("", "") == 1.0 and fingerprint.likeness("", mark(a)) == 0.0
    inside, _ = fingerprint.closed_syncmers(np.frombuffer(("zzz" + a).encode("utf-32-le"), np.uint32))
    alone, _ = fingerprint.closed_syncmers(np.frombuffer(a.encode("utf-32-le"), np.uint32))
    assert set(alone) <= set(inside)


def plain_anchors(text):
    """(hash, place) of every closed syncmer, each k-mer on its own."""
    out = []
    for i in range(len(text) - fingerprint.K + 1):
        hashes, _ = fingerprint.closed_syncmers(np.frombuffer(text[i : i + fingerprint.K].encode("utf-32-le"), np.uint32))
        out += [(int(h) >> 32, i) for h in hashes]
    return out or ([(int(hashlib.sha256(text.encode()).hexdigest()[:8], 16), 0)] if text else [])


def plain_likeness(a, b):
    """Longest common subsequence of all anchors by a whole table, over the union that counts repeats."""
    x, y = ([h for h, _ in plain_anchors(t)] for t in (a, b))
    if plain_anchors(a) == plain_anchors(b):
        return 1.0
    row = [0] * (len(y) + 1)
    for h in x:
        above, row = row, [0] * (len(y) + 1)
        for j, k in enumerate(y):
            row[j + 1] = above[j] + 1 if h == k else max(above[j + 1], row[j])
    return row[-1] / (Counter(x) | Counter(y)).total()


def test_fingerprint_has_every_anchor():
    for t in (prose(1, 800), "abcdefghij" * 60 + prose(2, 90) + "abcdefghij" * 30, "x" * 300, "short", "é" * 24):
        mark = fingerprint.fingerprint(t)
        assert [(int(mark[i : i + 8], 16), int(mark[i + 8 : i + 16], 16)) for i in range(0, len(mark), 16)] == plain_anchors(t)
    mark = fingerprint.fingerprint(LONG)
    assert len(mark) // 16 == len(fingerprint.closed_syncmers(np.frombuffer(LONG.encode("utf-32-le"), np.uint32))[0]) > 20_000


def test_likeness_sees_a_short_passage_of_long_texts():
    a, b, shared = prose(11, 20_000), prose(12, 20_000), "".join(chr(97 + i * i % 23 + i // 40 % 3) for i in range(330))
    mark = fingerprint.fingerprint
    far = fingerprint.likeness(mark(a), mark(b))
    near = fingerprint.likeness(mark(a[:9000] + shared + a[9000:]), mark(b[:70_000] + shared + b[70_000:]))
    assert near > far


def test_likeness_against_a_plain_table(monkeypatch):
    r = random.Random(6)
    parts = [prose(200 + i, 12) for i in range(8)] + ["abcdefghij" * 9, "x" * 60]
    mixed = ["\n".join(r.choices(parts, k=r.randrange(1, 9))) for _ in range(12)]
    mixed += [prose(1, 150), fingerprint.edited(prose(1, 150), prose(2, 150)), "short", ""]
    want = {(a, b): plain_likeness(a, b) for i, a in enumerate(mixed) for b in mixed[:i]}
    marks = {t: fingerprint.fingerprint(t) for t in mixed}
    by_meetings, by_bits = fingerprint._by_meetings, fingerprint._by_bits
    for other in (lambda x, y, each: by_meetings(x, y, each), lambda x, y, each: by_bits(x, y)):
        monkeypatch.setattr(fingerprint, "_by_meetings", other)
        monkeypatch.setattr(fingerprint, "_by_bits", lambda x, y, other=other: other(x, y, np.bincount(x, minlength=int(y.max()) + 1)))
        assert {(a, b): fingerprint.likeness(marks[a], marks[b]) for a, b in want} == want


def test_compared_to_next_against_a_plain_table(spark):
    bodies = [fingerprint.edited(prose(1, 90), prose(i, 90)) for i in range(6)] + [None, "", "short", "abcdefghij" * 40, prose(1, 90)]
    rows = {r.doc_id: r for r in fingerprint.compared_to_next(table(spark, [(i, t, "a") for i, t in enumerate(bodies)])).collect()}
    for i, t in enumerate(bodies):
        own, following = t or "", bodies[i - 1] or ""
        changed = fingerprint.edited(own, following)
        assert (rows[i].near_edited, rows[i].near_next) == (plain_likeness(own, changed), plain_likeness(own, following))
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (fingerprint.fingerprint(own), fingerprint.fingerprint(changed))


def test_word_hashes_do_not_depend_on_their_place():
    hashes, first, starts, stops = hashed_words([b"a bb a", b"", b"bb  a"])
    assert list(first) == [0, 3, 3, 5] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]


def test_short_notices_need_their_order(spark):
    """Texts that hold all words of a notice somewhere, and texts that bear it."""
    bare = [
        "the book was released in may under a pseudonym; its author took a driving license test near mit",
        "photo licensed to us, see section 4 page 0; by john, cc to mary, under embargo, nc state",
        "released in may under the terms: mit people hold a license",
        "version 2 of the apache story was licensed under duress, the license has 0 pages",
        "license mit the under released",
    ]
    real = [("Released under the MIT License.", "mit"), ("it was released yesterday under the MIT license and so on", "mit"), ("Licensed under the Apache License, Version 2.0", "apache-2")]
    texts_ = bare + [f"{prose(i, 70)} {t} {prose(i + 9, 70)}" for i, t in enumerate(bare)] + [t for t, _ in real] + [f"{prose(i, 90)} {t} {prose(i + 50, 90)}" for i, (t, _) in enumerate(real)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(table(spark, [(i, t, "a") for i, t in enumerate(texts_)])).collect()}
    n = 2 * len(bare)
    assert [got[i] for i in range(n)] == [""] * n
    assert [got[i] for i in range(n, len(texts_))] == [label for _, label in real] * 2


@pytest.mark.parametrize("hot", [7, None])
def test_a_crowded_id_is_cut(spark, hot):
    """A third of the rows of one id (or of none), which lie in many ranges and still follow one another."""
    r = random.Random(4)
    rows = [(i, prose(i, 30)) for i in range(5, 65)] + [(hot, f"{r.randrange(10**6)} {prose(100 + i, 30)}") for i in range(30)] + [(hot, "same text")] * 3
    df = table(spark, [(i, t, "a") for i, t in rows])
    parts = fingerprint.next_to_each_other(df, "text", "doc_id", 1000).where("extra = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("doc_id").eqNullSafe(F.lit(hot))).alias("n")).collect()
    assert len(parts) > 12 and sum(x.n > 0 for x in parts) > 5
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = Counter()
    for (i, t), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        want[i, hashlib.sha256(fingerprint.edited(t, other).encode()).hexdigest(), fingerprint.fingerprint(t)] += 1
    got = Counter((x.doc_id, x.edited_sha256, x.fingerprint) for x in fingerprint.compared_to_next(df, range_bytes=1000).collect())
    assert got == want
