"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Equal fingerprints are one trie leaf, so copies cost nothing. The trie is cut below its first bits:
two nodes whose prefixes differ in at most the error budget form a unit of work, and Spark deals
the units. Inside a unit pairs of nodes are walked down together; differing bits add up, and a pair
over the budget is pruned with all that is below it. A unit returns a spanning forest of its links,
never all pairs of a group; components of the forests are the classes.

Cases: null, empty and wordless texts have the fingerprint zero and link like any other; fewer words
than a shingle make one shingle of all words; texts of any length are used whole; a null id never
names a class unless no other id is in it; equal rows fall into one class; other columns are kept."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from keelson.llm.common import bounded_batches, free_name, map_columns, stored
from keelson.registry import query

SHINGLE, BUDGET, SEED = 3, 3, 42
UNIT_ROWS = 65_536  # fingerprints below a cut node, on average: sets the number of cut bits
DIRECT = 64  # node pairs with at most so many fingerprint pairs are compared directly
FRONTIER = 1_000_000  # node pairs that are expanded at a time


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that more than half of n hashes have."""
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > n))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 65_536):
        part = [digest(join(words[i : i + shingle]), SEED) for i in range(low, min(n, low + 65_536))]
        ones += bit_counts(np.array(part, "<u8"))
    return majority(ones, n)


def with_fingerprint(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""
    bounded_batches(documents.sparkSession)

    def compute(batch: pa.RecordBatch) -> list:
        made = np.array([fingerprint(x, shingle) for x in batch.column(0).to_pylist()], np.uint64)
        return [pa.array(made.view(np.int64))]

    return map_columns(documents, [F.col(text).cast("binary")], [StructField(name, LongType())], compute, documents.columns)


class Forest:
    """Union-find over places of an array, fed with batches of links."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)  # of several links of a root the smallest is taken; the rest come again
        self.parent = self.root(np.arange(len(self.parent)))


class Level:
    """Nodes of a sorted array at one depth: first place of each, and the last node below each parent."""

    def __init__(self, values: np.ndarray, depth: int):
        prefix = values >> np.uint64(64 - depth) if depth else np.zeros(len(values), np.uint64)
        self.first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(values) else np.zeros(0, np.int64)
        self.prefix = prefix[self.first]
        self.end = np.r_[self.first[1:], len(values)]


def trie_links(left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int, forest: Forest) -> None:
    """Links all pairs of ``left`` x ``right`` (sorted, distinct) within ``budget`` differing bits.

    Places of ``right`` follow those of ``left`` in the forest, unless both are the ``same`` array.
    The walk begins at ``depth``, above which all of ``left`` and all of ``right`` agree."""
    shift = 0 if same else len(left)
    if not len(left) or not len(right):
        return
    step = 2
    depths = [depth, *range(depth + step - depth % step, 65, step)]
    levels = [(Level(left, d), Level(right, d)) for d in depths]
    start = np.bitwise_count(levels[0][0].prefix[:1] ^ levels[0][1].prefix[:1]).astype(np.int64)
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), start)]
    while stack:
        at, a, b, spent = stack.pop()
        la, lb = levels[at]
        sizes = (la.end[a] - la.first[a]) * (lb.end[b] - lb.first[b])
        leaf = (sizes <= DIRECT) | (at == len(depths) - 1)
        _compare(left, right, la, lb, a[leaf], b[leaf], same, shift, budget, forest)
        a, b, spent = a[~leaf], b[~leaf], spent[~leaf]
        if not len(a):
            continue
        na, nb = levels[at + 1]
        bits = np.uint64((1 << (depths[at + 1] - depths[at])) - 1)
        # children of a node are the next level's nodes between its first and its last place
        fa, ea = np.searchsorted(na.first, la.first[a]), np.searchsorted(na.first, la.end[a])
        fb, eb = np.searchsorted(nb.first, lb.first[b]), np.searchsorted(nb.first, lb.end[b])
        pair, i, j = _product(fa, ea - fa, fb, eb - fb)
        cost = spent[pair] + np.bitwise_count((na.prefix[i] ^ nb.prefix[j]) & bits)
        keep = cost <= budget
        if same:
            keep &= i <= j
        i, j, cost = i[keep], j[keep], cost[keep]
        for low in range(0, len(i), FRONTIER // 16):
            part = slice(low, low + FRONTIER // 16)
            stack.append((at + 1, i[part], j[part], cost[part]))


def _product(first_a, count_a, first_b, count_b):
    """All (pair, i, j) with i and j running over the ranges of each pair."""
    total = count_a * count_b
    pair = np.repeat(np.arange(len(total)), total)
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return pair, first_a[pair] + place // count_b[pair], first_b[pair] + place % count_b[pair]


def _compare(left, right, la, lb, a, b, same, shift, budget, forest) -> None:
    for low in range(0, len(a), FRONTIER // DIRECT):
        x, y = a[low : low + FRONTIER // DIRECT], b[low : low + FRONTIER // DIRECT]
        _, i, j = _product(la.first[x], la.end[x] - la.first[x], lb.first[y], lb.end[y] - lb.first[y])
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        forest.link(i[near], j[near] + shift)


def forest_edges(left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a unit as (member, root) pairs of values."""
    values = left if same else np.concatenate([left, right])
    forest = Forest(len(values))
    trie_links(left, right, same, depth, budget, forest)
    member = np.flatnonzero(forest.parent != np.arange(len(values)))
    return values[member], values[forest.parent[member]]


def trie_join(prints: DataFrame, budget: int = BUDGET, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``budget`` bits.

    ``prints``: distinct 64-bit values in the column simhash."""
    n = prints.count()
    bits = min(20, max(6, math.ceil(math.log2(max(2, n) / unit_rows))))
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    prefix = F.shiftrightunsigned("simhash", 64 - bits)
    other = F.col("prefix").bitwiseXOR(F.col("mask"))
    dealt = prints.select("simhash", prefix.alias("prefix"), F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask"))
    units = dealt.select("simhash", (F.least("prefix", other) * (1 << bits) + F.greatest("prefix", other)).alias("unit"))

    def walk(key, table):
        unit = key[0].as_py()
        values = np.unique(table.column("simhash").to_numpy().view(np.uint64))
        a, b = unit >> bits, unit & ((1 << bits) - 1)
        head = (values >> np.uint64(64 - bits)).astype(np.int64)
        member, root = forest_edges(values[head == a], values[head == b], a == b, bits, budget)
        return pa.table({"a": member.view(np.int64), "b": root.view(np.int64)})

    return units.groupBy("unit").applyInArrow(walk, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable value of every node: (node, component). ``links``: distinct a, b.

    Every round takes the smallest label of the neighbours (combined before the shuffle, so hubs are
    cheap) and jumps pointers, until nothing changes. The sides of each join are stored tables, so
    that Spark can split the rows of a hub or of a large class."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = stored(both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hooked = stored(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = stored(hooked.join(jump, "component").select("node", F.least("component", "root").alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def near_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, simhash and component_id (smallest id of the class) of every row."""
    rows = stored(with_fingerprint(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).drop("text"))
    prints = stored(rows.groupBy("simhash").agg(F.min("doc_id").alias("low")))
    links = stored(trie_join(prints.select("simhash"), budget).distinct())
    classes = components(links).select(F.col("node").alias("simhash"), "component")
    named = stored(prints.join(classes, "simhash", "left").withColumn("component", F.coalesce("component", "simhash")))
    lowest = stored(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of_print = stored(named.join(lowest, "component").select("simhash", "component_id"))
    return rows.join(of_print, "simhash").select("doc_id", "simhash", "component_id")


def hex_print(simhash: Column) -> Column:
    return F.lpad(F.lower(F.hex(simhash)), 16, "0")


def representatives(documents: DataFrame) -> DataFrame:
    """The documents without near-copies: of each class the row with the smallest id stays.

    Rows equal in id and fingerprint are one document; of a class without any id one row stays for
    each fingerprint."""
    id_, kept_print, own = free_name(documents, "_id", "_print", "_simhash")
    kept = near_copies(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_), F.col("simhash").alias(kept_print)).distinct()
    printed = with_fingerprint(documents, name=own)
    found = printed.join(stored(kept), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(kept_print)))
    return found.dropDuplicates([id_, kept_print]).select(*documents.columns)


@query("op10_simhash_trie")
def op10_simhash_trie(t):
    return near_copies(t.documents).select("doc_id", hex_print(F.col("simhash")).alias("fingerprint"), "component_id")
