"""Near-duplicate documents by DartMinHash signatures, banding, and an exact check.

A document is its set of runs of five words, each weighing as often as it stands. Darts fall on every element's region (weight by
rank) as a Poisson process that depends on the element alone, so two documents see the same darts where their regions
overlap. Each dart hashes to one of K coordinates, and a coordinate keeps the dart of lowest rank: signatures agree in a
coordinate with the probability of the weighted Jaccard similarity. Only the first darts are thrown, about K (ln K + 5) a
document, whatever its length; if a coordinate stays empty the ranks allowed are doubled.

Documents with the same set are one node. Nodes that share a band of ROWS coordinates meet in a bucket. In a bucket no
pairs are made but with one centre: the node that meets most others over all its bands; in a second round, where a bucket
still holds more than one class, with a centre of another class. Pairs are checked exactly on the full sets; those of
SIMILARITY or more are links, and classes are the connected components. What a centre can't tell, an exact join does: the
nodes of buckets that still hold several classes are joined on their rarest elements (prefix, length and positional filters,
for nodes of different classes only), which finds every link left among them. Similarity is the weighted one throughout: the
sum of the smaller over the sum of the larger counts.

Null and empty texts have no words: all of them are one class of their own. A text of one to four words is one run of them
all. Rows that repeat are in one class. The class id is the smallest doc_id in the class (null if all are null). Extra
columns are ignored by classes() and kept by drop_near_duplicates(). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, U, grams, hashed_words, mix, pieces, sequence_hash, shielded, text_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 42, 6
K = BANDS * ROWS
ROUNDS = 2
SKETCH = 16
SALT_HOLDERS = 1000  # holders of an element that meet in one task, about
_GOLD, _A, _B = U(0x9E3779B97F4A7C15), U(0x5851F42D4C957F2D), U(0x2545F4914F6CDD1D)


def elements(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of size words, sorted, and how often each stands."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = grams(words, size) if len(words) >= size else np.array([sequence_hash(words)])
    return np.unique(runs, return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signature(items: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """The identity of the lowest dart of each coordinate. weights: positive; None for 1 each."""
    if weights is None:
        cells, top, total = mix(items ^ _A), None, float(len(items))
    else:
        height = np.ceil(weights).astype(np.int64)  # an element's region is cut into cells of weight 1
        level = np.arange(height.sum()) - np.repeat(np.cumsum(height) - height, height)
        cells = mix(np.repeat(items, height) ^ mix(level.astype(np.uint64) + _A))
        top, total = np.minimum(1.0, np.repeat(weights, height) - level), float(np.sum(weights))
        top = None if (top == 1.0).all() else top  # whole weights fill their cells
    limit = k * (np.log(k) + 5) / total
    while True:
        lowest, identity = np.full(k, np.inf), np.zeros(k, np.uint64)
        active, below, roof, thrown = cells, np.zeros(len(cells)), top, 0
        width = max(1, int(np.ceil(limit)))
        while len(active):
            darts = mix(active[:, None] + (np.arange(thrown, thrown + width, dtype=np.uint64) + U(1)) * _GOLD)
            rank = below[:, None] + np.cumsum(-np.log(_uniform(darts)), axis=1)
            hit = rank <= limit
            if roof is not None:
                hit &= _uniform(mix(darts ^ _B)) < roof[:, None]
            dart, at = darts[hit], rank[hit]
            place = ((mix(dart ^ _A) >> U(32)) * U(k) >> U(32)).astype(np.int64)
            np.minimum.at(lowest, place, at)
            won = at == lowest[place]
            identity[place[won]] = dart[won]
            more = rank[:, -1] <= limit
            active, below, thrown = active[more], rank[more, -1], thrown + width
            roof = None if roof is None else roof[more]
        if np.isfinite(lowest).all():
            return identity
        limit *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix(key * _GOLD + rows[:, j])
    return key


def sketches(docs: DataFrame, weighted: bool) -> DataFrame:
    """(doc_id, text, row1, row2) to doc_id, row1, row2, a hash of the set (k1, k2), n elements, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                words, first, _, _ = hashed_words(texts)
                k1, k2, size, bands = [], [], [], []
                for i in range(len(texts)):
                    items, times = elements(words[first[i] : first[i + 1]])
                    of_set = items + mix(times.astype(np.uint64)) if weighted else items
                    k1.append(mix(of_set ^ _A).sum(dtype=np.uint64).astype(np.int64))
                    k2.append(mix(of_set ^ _B).sum(dtype=np.uint64).astype(np.int64))
                    size.append(len(items))
                    bands.append(band_keys(dart_signature(items, times.astype(float) if weighted else None)).astype(np.int64) if len(items) else None)
                new = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                kept = part.select(["doc_id", "row1", "row2"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], ["doc_id", "row1", "row2", "k1", "k2", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, row1 long, row2 long, k1 long, k2 long, n long, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, items, times): distinct runs and how often each stands, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                words, first, _, _ = hashed_words(texts)
                got = [elements(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [part.column("node"), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([t.astype(np.uint32).tobytes() if (t > 1).any() else b"" for _, t in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "items", "times"])

    return docs.mapInArrow(run, "node long, items binary, times binary")


def similarity(a: bytes, a_times: bytes, b: bytes, b_times: bytes, weighted: bool) -> float:
    """Jaccard similarity of two sets, or the weighted one of their counts."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not weighted:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    m = np.frombuffer(a_times, np.uint32) if a_times else np.ones(len(x), np.uint32)
    n = np.frombuffer(b_times, np.uint32) if b_times else np.ones(len(y), np.uint32)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(m[i], n[j]).sum())
    return low / (int(m.sum()) + int(n.sum()) - low)


def verified(pairs: DataFrame, of_node: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(*(v.as_py() for v in row), weighted) >= threshold for row in zip(*(batch.column(c) for c in ("a_items", "a_times", "b_items", "b_times")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = of_node.select(F.col("node").alias("a"), F.col("items").alias("a_items"), F.col("times").alias("a_times"))
    right = of_node.select(F.col("node").alias("b"), F.col("items").alias("b_items"), F.col("times").alias("b_times"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_items", "a_times", "b_items", "b_times").mapInArrow(run, "a long, b long")


def unlike_nodes(inside: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, cls) of all nodes in buckets that hold several classes. inside: bucket, node, cls."""
    mixed = inside.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high")
    return inside.join(scratch.write(mixed.select("bucket"), "mixed"), "bucket").select("node", "cls").distinct()


def prefix_pairs(nodes: DataFrame, of_node: DataFrame, threshold: float, weighted: bool, scratch: Scratch, salt_holders: int = SALT_HOLDERS) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share an element of both prefixes, and whose sizes allow the threshold.

    Elements are ordered by the number of nodes that hold them, rarest first. Of two sets of n and m elements with a Jaccard
    similarity of t or more, the first n - ceil(t n) + 1 and m - ceil(t m) + 1 share one. Elements of one node alone come
    first and only fill the prefix. With weights, an element is as many elements as it stands times.

    Two more filters stand in the join's condition, so that what they refuse is never made. Both keep every link. Such sets
    share at least ``needed = ceil(t (n + m) / (1 + t))`` elements: so many must lie at or behind the first shared one
    (positions), and n + m - 2 needed at most are in one set alone. Each of these flips one bit between the sets' parity
    sketches (an element flips one of SKETCH * 64 bits), so the sketches may not differ in more bits than that.

    The join's key is the element, a salt and a class of sizes. An element with more than salt_holders holders is dealt into
    salts: a set has one salt of its own and is met by the smaller sets of every salt, so that the comparisons of one element
    are spread over as many tasks. Its holders also fall into classes of size by powers of 1 / threshold; sets that may be
    alike are in the same class or in neighbours, and others never meet.
    """
    sketch = [f"s{j}" for j in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets_ = []
                for items, times in zip(part.column("items").to_pylist(), part.column("times").to_pylist(), strict=True):
                    items, times = np.frombuffer(items, np.uint64), np.frombuffer(times, np.uint32)
                    if weighted and len(times):
                        copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        items = mix(np.repeat(items, times) + copy.astype(np.uint64) * _GOLD)
                    sets_.append(items)
                n = np.array([len(x) for x in sets_], np.int64)
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("node", "cls")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets_).view(np.int64))], ["node", "cls", "n", "item"])

    def parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            node, item = batch.column("node").to_numpy(), batch.column("item").to_numpy().view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            bits = (mix(item ^ _B) % U(SKETCH * 64)).astype(np.int64) + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node)))) * SKETCH * 64
            odd = (np.bincount(bits, minlength=len(first) * SKETCH * 64) & 1).astype(np.uint8)
            words = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(first), SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), *(pa.array(words[:, j]) for j in range(SKETCH))], ["node", *sketch])

    chosen = scratch.write(of_node.join(nodes, "node").select("node", "cls", "items", "times"), "prefix-sets")
    held = chosen.mapInArrow(run, "node long, cls long, n long, item long")
    common = scratch.write(held.groupBy("item").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "common-elements")
    of_one = W.partitionBy("node")
    ranked = held.join(common, "item").withColumns({"place": F.row_number().over(of_one.orderBy("holders", "item")), "shared": F.count(F.lit(1)).over(of_one)})
    reach = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    at = F.col("n") - F.col("shared") + F.col("place")
    prefix = ranked.where(at <= reach).select("node", "cls", "n", "item", "holders", (F.col("n") - at + 1).alias("behind"))
    sketches_ = chosen.mapInArrow(parity, "node long, " + ", ".join(f"{s} long" for s in sketch))
    salts = F.ceil(F.col("holders") / salt_holders).cast("int")
    size_class = F.when(F.col("salts") > 1, F.floor(F.log(F.col("n")) / -math.log(threshold)).cast("int")).otherwise(0)
    prefix = prefix.join(sketches_, "node").withColumn("salts", salts).withColumns({"sizes": size_class, "salt": F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")}).drop("holders")
    prefix = scratch.write(prefix, "prefixes")
    spread = prefix.withColumn("sizes", F.explode(F.when(F.col("salts") > 1, F.array(F.col("sizes") - 1, F.col("sizes"))).otherwise(F.array("sizes"))))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = prefix.alias("a"), spread.alias("b")  # a is not larger than b
    both = F.col("a.n") + F.col("b.n")
    needed = F.ceil(both * (threshold / (1 + threshold)) - 1e-9)
    sizes = (F.struct("a.n", "a.node") < F.struct("b.n", "b.node")) & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
    places = F.least("a.behind", "b.behind") >= needed
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in sketch), F.lit(0))
    near = sizes & places & (differ <= both - 2 * needed)
    keys = (F.col("a.item") == F.col("b.item")) & (F.col("a.sizes") == F.col("b.sizes")) & (F.col("a.salt") == F.col("b.salt"))
    met = a.join(b, keys & (F.col("a.cls") != F.col("b.cls")) & near)
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) to (node, cls): the smallest node of its connected component, by labels passed along links and shortcut."""
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("cls")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "cls"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cls").alias("heard"))
        new = labels.join(heard, "node").select("node", F.col("cls").alias("old"), F.least("cls", "heard").alias("cls"))
        jump = labels.select(F.col("node").alias("cls"), F.col("cls").alias("far"))
        new = scratch.write(new.join(jump, "cls", "left").select("node", "old", F.least("cls", F.coalesce("far", "cls")).alias("cls")), "labels")
        labels = new.select("node", "cls")
        if new.where("cls != old").isEmpty():
            return labels


def _class_of(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("cls", F.coalesce("cls", "node"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = SIMILARITY, weighted: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, n_docs (of the class), keep (true for one document a class), row1 and row2 (a hash of id and text), one row a document.

    weighted=False takes each run as often as any other.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    slim = slim.withColumns({"row1": F.xxhash64("doc_id", "text", F.lit(1)), "row2": F.xxhash64(F.lit(2), "text")})
    sketch = scratch.write(sketches(slim, weighted).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    same = sketch.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "row1", "row2")).alias("first"))
    nodes = scratch.write(same.select("k1", "k2", F.col("first.rid").alias("node"), F.col("first.row1").alias("row1"), F.col("first.row2").alias("row2")), "nodes")

    entries = sketch.where("n > 0").select(F.col("rid").alias("node"), "bands").join(nodes.select("node"), "node").select("node", F.explode("bands").alias("bucket"))
    # what is joined to a skewed side is written first: Spark splits hot keys of a join with a table, not with an aggregate
    shared = scratch.write(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "shared")
    met_all = scratch.write(entries.join(shared, "bucket"), "buckets")
    central = met_all.groupBy("node").agg(F.sum("met").alias("score"))
    met = scratch.write(met_all.select("bucket", "node").join(central, "node"), "buckets-scored")
    scratch.drop(shared, met_all)
    chosen = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "row1", "row2")
    of_node = scratch.write(sets(slim.join(chosen, ["row1", "row2"]).select("node", "text")).groupBy("node").agg(F.first("items").alias("items"), F.first("times").alias("times")), "sets")

    labels = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("cls"))
    tried = None
    for turn in range(rounds + 1):
        inside = _class_of(met, labels)
        if turn < rounds:
            top = scratch.write(inside.groupBy("bucket").agg(F.max(F.struct("score", "node", "cls")).alias("centre")), "tops")
            inside = inside.join(top, "bucket")
            if turn:
                others = inside.where("cls != centre.cls").groupBy("bucket").agg(F.max(F.struct("score", "node", "cls")).alias("centre"))
                inside = inside.drop("centre").join(scratch.write(others, "centres"), "bucket")
            pairs = inside.where("cls != centre.cls").select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()
        else:
            pairs = prefix_pairs(unlike_nodes(inside, scratch), of_node, threshold, weighted, scratch)
        pairs = scratch.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = scratch.write(verified(pairs, of_node, threshold, weighted), "links-found")
        if links.isEmpty():
            continue
        by_class = _class_of(_class_of(links.withColumnRenamed("a", "node"), labels).select(F.col("cls").alias("a"), F.col("b").alias("node")), labels).select("a", F.col("cls").alias("b"))
        joined = components(by_class, scratch)
        known = met.select("node").distinct()
        moved = _class_of(known, labels).join(joined.select(F.col("node").alias("cls"), F.col("cls").alias("to")), "cls", "left")
        labels = scratch.write(moved.select("node", F.coalesce("to", "cls").alias("cls")).where("node != cls"), "classes")

    member = _class_of(sketch.select("doc_id", "row1", "row2", "rid", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]), labels)
    whole = scratch.write(member.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("n_docs")), "whole")
    scratch.keep_only(sketch, nodes, whole, labels)
    return member.join(whole, "cls").select("doc_id", F.col("first.doc_id").alias("class_id"), "n_docs", (F.col("rid") == F.col("first.rid")).alias("keep"), "row1", "row2")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """docs with one document of each class, that of the smallest id; all columns as they are."""
    kept = classes(docs, text, key, threshold, weighted).where("keep").select(F.col("row1").alias("__row1"), F.col("row2").alias("__row2"))
    own, back = shielded(docs, {"__row1", "__row2", "__once"})
    own = own.withColumns({"__row1": F.xxhash64(F.col(key).cast("long"), text_of(text), F.lit(1)), "__row2": F.xxhash64(F.lit(2), text_of(text))})
    once = F.row_number().over(W.partitionBy("__row1", "__row2").orderBy("__row1"))
    return own.join(kept, ["__row1", "__row2"]).withColumn("__once", once).where("__once = 1").drop("__row1", "__row2", "__once").withColumnsRenamed(back)
