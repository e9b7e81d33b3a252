"""Conversation structure repair as a scan of min-plus matrices.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. That is an automaton of four states (nothing
yet, after system, after user, after assistant). Each turn becomes a 4x4 matrix: entry (i, j) is the cheapest way, as a pair
of cost and audit, to take the automaton from i to j over this turn, by keeping, reroling or deleting it, with the closure
of insertions before and after. Pairs add up by adding costs and joining audits; of several the least stays, which also
settles ties by the least audit (of two audits with the same ends and cost none is the beginning of the other, so the
choice is the same wherever it is made). This product is associative: turns are multiplied as a tree within a range of the
sorted rows, and the products of a conversation that lies in several ranges as a tree over these, sixteen at a time.

Turns that are alike in all columns are one row with a count on the way, and what follows the first of them is a duplicate.
A conversation's rows stand in order of turn (nulls first), then of ``role:text``, then of role.

Null role or text is one space. A null conv_id is a conversation of its own, a null turn comes first. Empty and white texts
are blank; texts are taken whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, key_runs

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAN_IN = 16
_WHITE = " \t\n\x0b\x0c\r"
#: What a role's initial does to the automaton: the states it may come after, and the state it leads to.
_STEPS = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
_LEGAL = {"su", "ua", "au"}

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: in each place the least (cost, audit) over the states between."""
    out: list[Entry] = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[0] + y[0], x, y) for k in range(4) if (x := a[i + k]) is not None and (y := b[4 * k + j]) is not None]
            if not ways:
                out.append(None)
                continue
            least = min(w[0] for w in ways)
            out.append((least, min(x[1] + y[1] for cost, x, y in ways if cost == least)))
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


def _closure() -> Matrix:
    """The cheapest insertions from any state to any other, none among them."""
    one = {(i, _STEPS[r][1]): (INSERT, "I") for r in "ua" for i in _STEPS[r][0]}
    step = _matrix(one | {(i, i): (0, "") for i in range(4)})
    return times(times(step, step), step)


INSERTS = _closure()


@lru_cache(maxsize=64)
def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """A turn's edits between the closures of insertions."""
    edits = {(i, i): (DELETE, "D") for i in range(4)}
    if not must_go:
        more = TRUNCATED if truncated else 0
        for role in "ua":
            edits |= {(i, _STEPS[role][1]): (REROLE + more, "R") for i in _STEPS[role][0]}
        if initial in _STEPS:
            edits |= {(i, _STEPS[initial][1]): (more, "K") for i in _STEPS[initial][0]}
    return times(times(INSERTS, _matrix(edits)), INSERTS)


def deleted(n: int) -> Matrix:
    """n turns that must go."""
    return tuple(e and (e[0] + n * DELETE, "D" * n + e[1]) for e in INSERTS)


@lru_cache(maxsize=1 << 15)
def _few(kinds: tuple[tuple[str, bool, bool], ...]) -> Matrix:
    if len(kinds) == 1:
        return turn_matrix(*kinds[0])
    half = len(kinds) // 2
    return times(_few(kinds[:half]), _few(kinds[half:]))


def tree(level: list[Matrix]) -> Matrix:
    """The product of matrices in order, as a balanced tree."""
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def product(turns: Iterable[tuple[str, str, int]]) -> Matrix:
    """turns: (initial, fault, copies) in order."""
    leaves: list[Matrix] = []
    some: list[tuple[str, bool, bool]] = []
    for initial, fault, n in turns:
        must_go = fault in ("blank", "duplicate")
        some.append((initial if initial in _STEPS else "", must_go, fault == "truncated"))
        if n > 1 or len(some) == 4:
            leaves.append(_few(tuple(some)))
            some = []
        if n > 1:
            leaves.append(deleted(n - 1))
    return tree(leaves + ([_few(tuple(some))] if some else []))


def best(m: Matrix) -> tuple[int, str]:
    """From nothing to nothing, or to an assistant's turn."""
    return min(e for e in (m[0], m[3]) if e is not None)


class Repair:
    """Applies an audit to rows that come one after the other, and hashes the repaired lines. Holds no row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.sha = hashlib.sha256()
        self.lines = 0

    def _emit(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if self.state == 2 else "user"
        self.state = _STEPS[role[:1]][1]
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(None, "")
            self.at += 1

    def feed(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                self._emit(role if letter == "K" else None, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


# What is known of a stretch of rows of one conversation; stretches in order are merged.

_STATS = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_STAT_NAMES = [x.split()[0] for x in _STATS.split(", ")]
_PARTS = f"conv_id {{id}}, part long, {_STATS}, costs array<long>, audits array<string>"


def _stretch(rows: list[tuple]) -> dict:
    """rows: (turn, role, fault, copies) in order."""
    turns = [t for t, *_ in rows if t is not None]
    out = {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for _, role, fault, n in rows:
        if fault:
            out[fault] += n if fault in ("blank", "duplicate") else 1
        if fault not in ("blank", "duplicate"):
            out["duplicate"] += n - 1
        out["illegal"] += n - 1 + (before is not None and before + role[:1] not in _LEGAL)
        before = role[:1]
    return out | {"first_role": rows[0][1][:1], "last_role": before}


def _merge(a: dict, b: dict) -> dict:
    both = {n: a[n] + b[n] for n in ("blank", "duplicate", "truncated")}
    both["illegal"] = a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in _LEGAL)
    both["turns"] = a["turns"] + b["turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
    both["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    both["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return both | {"first_role": a["first_role"], "last_role": b["last_role"]}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def with_faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text, copies) to the same and fault: the first fault of the first of the copies."""
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "text", "role"), "at": F.struct(F.col("turn").isNotNull().alias("has"), "turn")})
    rows = scratch.write(rows, "turns")
    first = rows.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = scratch.write(first.drop("rows"), "first-of-alike")  # a table, so that Spark can split a hot conversation
    r, f = rows.alias("r"), first.alias("f")
    met = r.join(f, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.h1") == F.col("f.h1")) & (F.col("r.h2") == F.col("f.h2")), "left")
    end = F.rtrim(F.col("r.text"), F.lit(_WHITE))
    fault = (
        F.when(end == "", "blank")
        .when(F.col("r.at") > F.col("f.first"), "duplicate")
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return met.select("r.conv_id", "r.turn", "r.role", "r.text", "r.copies", fault.alias("fault"))


def scanned(rows: DataFrame) -> DataFrame:
    """Rows of with_faults(), dealt by ranges of their order and scanned: kind done (a conversation that lies within one
    range, with its result), part (the product of a stretch of a conversation at an end of the range) or row (its rows)."""
    line = F.concat_ws(":", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring(line, 1, 64)).sortWithinPartitions("conv_id", "turn", line, "role")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    fields = f"kind string, {_PARTS.format(id=id_type)}, cost long, audit string, sha string, place long, role string, text string, copies long"
    schema = rows.sparkSession.createDataFrame([], fields).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, first = TaskContext.get().partitionId(), 0, None, True

        def told(run_: list[tuple], inner: bool) -> list[dict]:
            nonlocal place
            conv = run_[0][0]
            stats = {"conv_id": conv, "part": part} | _stretch([(t, r, f, n) for _, t, r, _, n, f in run_])
            m = product((r[:1], f, n) for _, _, r, _, n, f in run_)
            if inner:
                cost, audit = best(m)
                repair = Repair(audit)
                for _, _, role, text, n, _ in run_:
                    repair.feed(role, text, n)
                return [stats | {"kind": "done", "cost": cost, "audit": audit, "sha": repair.digest()}]
            out = [stats | {"kind": "part", "costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m]}]
            for _, _, role, text, n, _ in run_:
                out.append({"kind": "row", "conv_id": conv, "part": part, "place": place, "role": role, "text": text, "copies": n})
                place += 1
            return out

        done: list[dict] = []
        for table in key_runs(batches, ["conv_id"]):
            if held is not None:
                done += told(held, inner=not first)
                first = False
            held = list(zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True))
            if len(done) >= 512:
                yield _batch(done, schema)
                done = []
        if held is not None:
            done += told(held, inner=False)
        for i in range(0, len(done), 512):
            yield _batch(done[i : i + 512], schema)

    return dealt.mapInArrow(run, fields)


def reduced(parts: DataFrame, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """Products of stretches to one row a conversation: a tree over the stretches of a conversation, fan_in at a time."""
    fields = parts.schema
    schema = parts.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, ["conv_id", "part"]):
            rows = table.to_pylist()
            out = rows[0]
            for row in rows[1:]:
                out = out | _merge(out, row)
            m = tree([tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows])
            yield _batch([out | {"costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m]}], schema)

    # a conversation has no more stretches than there are partitions
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("part")) - 1
    level = scratch.write(parts.withColumn("part", number.cast("long")), "stretches")
    most = level.agg(F.max("part")).first()[0] or 0
    while most > 0:
        blocks = level.withColumns({"order": F.col("part"), "part": F.floor(F.col("part") / fan_in).cast("long")})
        blocks = blocks.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "order").drop("order")
        level, most = scratch.write(blocks.mapInArrow(run, fields), "stretches"), most // fan_in
    return level


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, sha) of the repaired lines. Each conversation's audit comes before its rows, which stream past it."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    stream = audits.select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    stream = stream.unionByName(rows.select("conv_id", "part", "place", "role", "text", "copies"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    schema = rows.select("conv_id", F.lit("").alias("sha")).limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv = None, None
        for batch in batches:
            for c, place, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text", "copies")), strict=True):
                if place >= 0:
                    repair.feed(role, text, copies)
                    continue
                if repair is not None:
                    yield _batch([{"conv_id": conv, "sha": repair.digest()}], schema)
                repair, conv = Repair(text), c
        if repair is not None:
            yield _batch([{"conv_id": conv, "sha": repair.digest()}], schema)

    return stream.mapInArrow(run, f"conv_id {id_type}, sha string")


def _answer(costs: Column, audits: Column) -> Column:
    """(cost, audit) of best() over the arrays of a product."""
    ends = F.filter(F.array(*(F.struct(costs[i].alias("cost"), audits[i].alias("audit")) for i in (0, 3))), lambda e: e["cost"].isNotNull())
    return F.array_min(ends)


def repair_conversations(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) to one row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. copies names a column with the number of times that a row stands, one after the other."""
    scratch = Scratch(rows.sparkSession, "conversations")
    n = F.col(copies) if copies else F.lit(1)
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), n.cast("long").alias("copies"))
    told = scratch.write(scanned(with_faults(slim, scratch)), "scanned")
    done = told.where("kind = 'done'").select("conv_id", *_STAT_NAMES, "cost", "audit", "sha")
    parts = told.where("kind = 'part'").select("conv_id", "part", *_STAT_NAMES, "costs", "audits")
    whole = scratch.write(reduced(parts, scratch).withColumn("best", _answer(F.col("costs"), F.col("audits"))).select("conv_id", *_STAT_NAMES, "best.cost", "best.audit"), "whole")
    shas = hashed(told.where("kind = 'row'"), whole).withColumnRenamed("conv_id", "__id")
    ends = whole.join(shas, F.col("conv_id").eqNullSafe(F.col("__id"))).drop("__id")
    out = done.unionByName(ends)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by the checksum of ``conv_id:turn``, and copies: dropped, emptied, cut off, repeated, reroled."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of rows after damaged(), repaired; one that lost all its rows has nothing to repair."""
    fixed = repair_conversations(damaged(rows), "copies").withColumnRenamed("conv_id", "__id")
    ids = rows.select("conv_id").distinct()
    out = ids.join(fixed, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
