"""Conversation repair, the Merkle manifest and lattice hashing: brute force, SQL on odd tables, small parameters."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import conversation_repair, embedding_dedup, merkle
from starloom.llm.oracles import ORACLES
from starloom.llm.queries import QUERIES
from tests.parity import assert_parity, connect

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def saved(df, tmp_path, name):
    """df as the one file that both engines read."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/whole")
    next((tmp_path / "whole").glob("part*.parquet")).replace(tmp_path / f"{name}.parquet")
    for left in (tmp_path / "whole").iterdir():
        left.unlink()
    (tmp_path / "whole").rmdir()


# conversations

TURNS = "conv_id long, turn long, role string, text string"
INITIALS = {"system": "s", "user": "u", "assistant": "a"}


def well_formed(roles):
    r = "".join(x[:1] for x in roles)
    r = r[1:] if r.startswith("s") else r
    return not roles or bool(r) and r == "ua" * (len(r) // 2) and len(r) % 2 == 0


def brute_repair(rows):
    """The least (cost, audit) over all edits of a few rows, at most three insertions between two, and its lines."""
    choices, seen = [], set()
    for _, role, text in rows:
        blank, again = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        ways = [(3, "D", None)]
        if not blank and not again:
            ways += [(0 + cut, "K", (role, text))] + [(2 + cut, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(ways)
    inserts = [(2 * n, "I" * n, [(r, "") for r in c]) for n in range(4) for c in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more, letters, new in inserts:
            if i == len(choices):
                out = lines + new
                if well_formed([r for r, _ in out]) and (best is None or (cost + more, audit + letters) < best[:2]):
                    best = (cost + more, audit + letters, out)
                continue
            for c, letter, line in choices[i]:
                go(i + 1, cost + more + c, audit + letters + letter, lines + new + ([line] if line else []))

    go(0, 0, "", [])
    return best[0], best[1], SHA("\n".join(f"{r}:{t}" for r, t in best[2]))


def small_conversations(n, seed):
    r, out = random.Random(seed), []
    for conv in range(n):
        out += [(conv, t, r.choice(["system", "user", "assistant", "tool"]), r.choice(["Hello.", "What now", "Why?", "  ", "Fine! \n", ""])) for t in range(r.randint(1, 4))]
    return out


def test_repairs_are_the_cheapest(spark):
    rows = small_conversations(120, 5)
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in conversation_repair.repair_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn, role, text))
    assert got == {conv: brute_repair(rs) for conv, rs in of.items()}


def test_matrix_product_is_associative():
    r = random.Random(3)
    kinds = [(i, m, t) for i in ("s", "u", "a", "") for m in (True, False) for t in (True, False)]
    for _ in range(50):
        a, b, c = (conversation_repair.turn_matrix(*r.choice(kinds)) for _ in range(3))
        assert conversation_repair.times(conversation_repair.times(a, b), c) == conversation_repair.times(a, conversation_repair.times(b, c))
    go = conversation_repair.turn_matrix("u", True, False)
    assert conversation_repair.deleted(3) == conversation_repair.tree([go] * 3)


def forward(rows):
    """The cheapest repair by stepping over the states, turn by turn: for long conversations."""
    ways = {0: (0, "")}

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                to = 3 if s == 2 else 2
                out[to] = min(out.get(to, (10**9, "")), (c + 2, a + "I"))
        return out

    seen = set()
    for role, text in rows:
        must_go = not text.strip() or (role, text) in seen
        seen.add((role, text))
        cut = text.rstrip()[-1:] not in (".", "!", "?")
        new = {}
        for s, (c, a) in inserted(ways).items():
            steps = [(s, c + 3, a + "D")]
            if not must_go:
                steps.append((3 if s == 2 else 2, c + 2 + cut, a + "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                steps += [(to, c + cut, a + "K")] if to else []
            for to, cost, audit in steps:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        ways = new
    ways = inserted(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


def test_long_conversation_over_many_ranges(spark):
    r = random.Random(8)
    long_ = [(7, t, r.choice(["system", "user", "assistant"]), r.choice(["Yes.", "No?", "Maybe", f"It is {t}.", f"Some {t}"])) for t in range(3000)]
    rows = long_ + [(c, t, role, f"{c} {t}.") for c in (6, 8) for t, role in enumerate(["user", "assistant"])]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.conv_id: x for x in conversation_repair.repair_conversations(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got[6].audit, got[8].audit) == ("KK", "KK")
    assert (got[7].cost, got[7].audit) == forward([(role, text) for _, _, role, text in long_])
    repair, lines = conversation_repair.Repair(got[7].audit), 0
    for _, _, role, text in long_:
        repair.feed(role, text, 1)
    assert got[7].repaired_sha256 == repair.digest()
    assert got[7].gaps == 0 and got[7].illegal == sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(long_, long_[1:]))


ODD_TURNS = [
    (1, None, "user", "No turn."),
    (1, None, None, None),
    (1, 3, "user", "Hello."),
    (1, 3, "user", "Hello."),
    (1, 3, "assistant", "Hi."),
    (1, 9, "", "Nobody."),
    (None, 1, "user", "Who am I?"),
    (None, 2, "assistant", "You."),
    (None, None, "tool", "x"),
    (2, 1, "system", "Be kind. " * 20_000),
    (2, 2, "user", "naïve 日本語?"),
    (2, 5, "assistant", "ok…"),
    (3, 4, "User", "Upper."),
] + [(4 + i % 40, i // 40, ("system", "user", "assistant")[i % 3], f"text {i % 11}" + ".?! "[i % 4]) for i in range(400)]


def test_odd_conversations_equal_sql(spark, tmp_path):
    df = spark.createDataFrame(ODD_TURNS, TURNS).withColumns({n: F.lit(f"own {n}") for n in ("copies", "fault", "kind", "part", "cost", "audit", "sha", "place", "gaps")})
    saved(df.repartition(3), tmp_path, "conversations")
    assert_parity(QUERIES["op11_min_plus_repair"](spark, str(tmp_path)), connect(tmp_path), ORACLES["op11_min_plus_repair"])
    kinds = Counter(zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, *_ in ODD_TURNS)
    assert all(kinds[k] for k in range(5))


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair_damaged(none).count() == conversation_repair.repair_conversations(none).count() == 0


def test_conversation_without_a_row_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [r] = conversation_repair.repair_damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], TURNS)).collect()
    assert r == (conv, 0, 0, 0, 0, 0, 0, "", SHA(""))


# Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_manifest(rows, fan_in=16):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, text):
        return SHA("".join(map(enc, (d[0], d[3], d[2], d[4], text))))

    def tree(digests):
        """root, and each leaf's levels as (left, right)"""
        ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p // fan_in * fan_in :][:fan_in]
                ways[i].append((run[: p % fan_in], run[p % fan_in + 1 :]))
            level = [SHA("".join(level[i : i + fan_in])) for i in range(0, len(level), fan_in)]
            at = [p // fan_in for p in at]
        return level[0], ways

    by = defaultdict(list)
    for d in rows:
        by[d[3]].append(d)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        by[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        own[s] = tree([leaf(d, d[1]) for d in by[s]])
    root, above = tree([own[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for d, way in zip(by[s], own[s][1], strict=True):
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[1] is not None
            node = leaf(d, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1]) if tampered else d[1])
            proof = ""
            for left, right in way + up:
                node, proof = SHA("".join([*left, node, *right])), proof + "".join(left + right)
            out.append((d[0], leaf(d, d[1]), own[s][0], root, SHA(proof), node, node == root))
    return sorted(out, key=repr)


def some_docs(sizes, seed=1):
    r, out = random.Random(seed), []
    for source, n in sizes.items():
        out += [(r.randrange(10_000), r.choice([None, "", "Some Text", "lower", f"Ünï {r.random()}"]), r.choice([None, "en"]), source, r.choice([None, 3])) for _ in range(n)]
    return out


@pytest.mark.parametrize(
    ("sizes", "shape"),
    [
        ({"a": 40, None: 17, "b": 1, "-": 16, "é": 257}, (16, 3, 4096)),
        ({"a": 200, None: 3, "b": 1, "c": 9, "é": 33}, (2, 2, 8)),
        ({f"s{i}": 1 + i % 3 for i in range(60)}, (3, 1, 5)),
        ({"only": 1}, (16, 3, 4096)),
        ({"only": 130}, (4, 1, 2)),
    ],
)
def test_manifest_against_brute_force(spark, sizes, shape):
    rows = some_docs(sizes)
    rows += [(None, "No Id", "en", next(iter(sizes)), 5), rows[0]]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(3), *shape)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows, shape[0])


def test_manifest_of_odd_tables(spark, tmp_path):
    rows = some_docs({"a": 30, None: 20, "b": 300}, 4) + [(50_000, "Long Text " * 50_000, "en", "a", 1), (50_005, "Upper " * 9, "en", "zz", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("own") for n in ("leaf", "root", "node", "idx", "tree", "n", "tried", "path", "range", "place")})
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=repr) == brute_manifest(rows)
    saved(df, tmp_path, "documents")
    assert_parity(QUERIES["op12_merkle_manifest"](spark, str(tmp_path)), connect(tmp_path), ORACLES["op12_merkle_manifest"])
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_tells_what_was_tampered_with(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = merkle.manifest(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r.text or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)
    assert {r.verified for r in rows} == {True, False}


# embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.95):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    links = defaultdict(set)
    for i, j in itertools.combinations(good, 2):
        a, b = good[i], good[j]
        if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
            links[i].add(j)
            links[j].add(i)
    out, label = [], {}
    for i in range(len(rows)):
        if i not in label:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            label |= dict.fromkeys(group, min(ids, default=None))
    for i, (vec, _) in enumerate(rows):
        out.append((vec, len(links[i]), label[i], vec == label[i]))
    return sorted(out, key=repr)


def at_cosine(rng, base, c):
    g = rng.normal(size=base.shape)
    g -= g @ base * base
    return c * base + np.sqrt(1 - c * c) * g / np.linalg.norm(g)


def planted(seed=2, dim=64, families=30):
    rng, out = np.random.default_rng(seed), []
    for f in range(families):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        out.append(base)
        for c in (0.94, 0.949, 0.951, 0.96, 0.99, 0.9999, 1.0)[: 1 + f % 7]:
            out.append(at_cosine(rng, base, c) * rng.choice([1, 0.01, 300]))
        step = base
        for _ in range(f % 4):  # a chain, whose ends are not alike
            step = at_cosine(rng, step, 0.97)
            out.append(step)
    return [v.astype(np.float32).tolist() for v in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("chunk", [1024, 7])
def test_links_against_brute_force(spark, chunk):
    rows = list(enumerate(planted()))
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, at_cosine(np.random.default_rng(i), np.eye(64)[3], 0.99).astype(np.float32).tolist()) for i in range(60)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)


def test_odd_vectors(spark, tmp_path):
    v = planted(9, 64, 3)
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [None] + [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [float("inf")] + [1.0] * 63), (7, v[0]), (7, v[0]), (None, v[0]), (8, v[0][:32]), (9, [x * 1e-30 for x in v[0]]), (10, [1.0]), (11, [2.0]), (12, [-1.0]), (None, [3.0, 4.0]), (13, v[0])]
    df = vectors(spark, rows).withColumns({n: F.lit("own") for n in ("n_links", "kept", "node", "cell", "k1", "valid", "cls", "component_id", "copies")})
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr) == brute_links(rows)
    saved(df, tmp_path, "embeddings")
    assert_parity(QUERIES["op13_e8_lattice"](spark, str(tmp_path)), connect(tmp_path), ORACLES["op13_e8_lattice"])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of just 0.95, of which all tables miss next to none, and what a table lets meet by chance."""
    rng = np.random.default_rng(11)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.stack([at_cosine(rng, x, 0.95) for x in a])
    met = np.zeros(3000, bool)
    chance = []
    for t in range(embedding_dedup.TABLES):
        x, y = embedding_dedup.cells(a, t), embedding_dedup.cells(b, t)
        now = (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
        assert 0.45 < now.mean() < 0.6
        met |= now
        chance.append(len(x) - len(np.unique(x[:, 0])))
    assert met.mean() > 0.999 and np.mean(chance) < 50


def test_e8_points_are_the_nearest():
    y = np.random.default_rng(1).uniform(-3, 3, (500, 8))
    p = embedding_dedup.e8(y)
    twice = (2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1) & (twice.sum(1) % 4 == 0)).all()
    best = ((y - p) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()  # the lattice's covering radius
    assert all((((y - p - s) ** 2).sum(1) >= best - 1e-9).all() for s in embedding_dedup.SHORTEST)
