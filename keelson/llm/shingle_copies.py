"""Near-copies by the exact Jaccard similarity of word shingles.

Each text has a SimHash fingerprint of its shingles, and the trie join of op10 links fingerprints of three or
fewer differing bits; a link stands if the sets of shingles are similar enough. Fingerprints of similar texts
often differ in more bits, so the search goes on. Each text has a MinHash signature that is hashed in bands. Inside a bucket every text is first compared
with one pivot, then with pivots of smaller parts, which makes one class of a large group. Texts of buckets that still hold several classes are open:
similar pairs among them are found by an exact prefix join. Shingles are ordered by how many open texts
have them, rare ones first; a similar pair shares a shingle among the first ones of both, and the places
of the first shared one bound what the rest can have in common. Texts of one form share common shingles
only, which stand behind, so they do not meet: a pair whose own parts are larger than 1 / 9 of the one
and 1 / 5 of the other text is never looked at. Every pair that is left is decided by the sets themselves.
A pair at the threshold misses all bands with probability (1 - LEAST ** ROWS) ** BANDS, 3 in a million.

Cases: null, empty and wordless texts are one class; fewer words than a shingle make one shingle of
all words; texts of any length are used whole; texts are told apart by 64 bits of hash."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from keelson.llm.common import bounded_batches, free_name, map_columns, stored
from keelson.llm.near_copies import bit_counts, components, majority, trie_join

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SEED = 24, 4, 42
PARTS = (1 << 40, 16, 4)  # members for each pivot, round by round: the whole bucket first
BLOCK = 1024  # shingles that are permuted at a time

_FACTOR, _OFFSET = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FACTOR |= np.uint64(1)


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the word shingles, sorted."""
    return np.unique(hashes(text, shingle))


def fingerprint(members: np.ndarray) -> int:
    """SimHash of the shingles, as ``near_copies.fingerprint`` makes it."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(members), BLOCK):
        ones += bit_counts(members[low : low + BLOCK])
    return majority(ones, len(members))


def bands(members: np.ndarray) -> np.ndarray:
    """Hashes of the bands of the MinHash signature; none for an empty set."""
    if not len(members):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(members), BLOCK):
        np.minimum(low, (members[at : at + BLOCK] * _FACTOR + _OFFSET).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def text_key(text: Column) -> Column:
    """Hash of a text; all texts without a word have one."""
    return F.xxhash64(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit("")))


def _described(df: DataFrame, of) -> DataFrame:
    """key, members (``of`` the shingles of _text) and n (number of shingles)."""
    bounded_batches(df.sparkSession)

    def compute(batch: pa.RecordBatch) -> list:
        sets = [shingles(x) for x in batch.column(0).to_pylist()]
        return [pa.array([of(x) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64())]

    return map_columns(df, [F.col("_text").cast("binary")], [StructField("members", ArrayType(LongType())), StructField("n", LongType())], compute, ["key"])


def _marked(df: DataFrame) -> DataFrame:
    """key, simhash and members (bands) of _text; the shingles are hashed once for both."""
    bounded_batches(df.sparkSession)

    def compute(batch: pa.RecordBatch) -> list:
        prints, marks = [], []
        for text in batch.column(0).to_pylist():
            made = hashes(text)
            prints.append(fingerprint(made))
            marks.append(bands(np.unique(made)))
        return [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(marks, pa.list_(pa.int64()))]

    added = [StructField("simhash", LongType()), StructField("members", ArrayType(LongType()))]
    return map_columns(df, [F.col("_text").cast("binary")], added, compute, ["key"])


def trie_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that the trie join of their fingerprints links; keys of one fingerprint meet its first key.

    ``prints``: key, simhash, distinct."""
    firsts = stored(prints.groupBy("simhash").agg(F.min("key").alias("first")))
    near = trie_join(firsts.select("simhash")).distinct()
    ends = near.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = prints.join(firsts, "simhash").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    return ends.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _described_once(keys: DataFrame, rows: DataFrame, lows: DataFrame) -> DataFrame:
    """key, members and n of the given keys, each from one text that has it."""
    used = keys.select("key").distinct().join(lows, "key").select(F.col("key").alias("_key"), "low")
    one = rows.join(used, (F.col("key") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("low")))
    return stored(_described(one.dropDuplicates(["_key", "low"]).select("key", "_text"), lambda x: x.view(np.int64)))


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets of shingles are similar enough."""
    left, right = (sets.select(F.col("key").alias(x), F.col("members").alias(f"of_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(common / (F.col("n_a") + F.col("n_b") - common) >= least).select("a", "b")


def prefix_pairs(sets: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of keys with different labels that can be similar: exact, no similar pair is left out.

    ``sets``: key, members (distinct), n. ``labels``: key, label."""
    near = least - 1e-9
    tokens = sets.select("key", F.explode("members").alias("token"))
    # a shingle that one text has cannot be shared; such ones come first and only move the places of the others
    counts = tokens.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = tokens.join(counts, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("order"))  # as many as the text has
    of_key = shared.join(sets.select("key", "n"), "key").join(labels, "key")
    alone = F.col("n") - F.size("order")
    probing = F.col("n") - F.ceil(near * F.col("n")) + 1 - alone  # places behind the shingles of its own
    placed = of_key.where(probing > 0).select("key", "label", "n", alone.alias("alone"), F.posexplode(F.slice("order", 1, probing.cast("int"))).alias("i", "x"))
    placed = stored(placed.select("key", "label", "n", (F.col("alone") + F.col("i")).alias("place"), F.col("x.token").alias("token")))
    # with a text that is no smaller, the pair must share more: the smaller text needs a shorter prefix
    indexed = placed.where(F.col("place") <= F.col("n") - F.ceil(2 * near / (1 + near) * F.col("n")))
    a, b = (x.select("token", *[F.col(y).alias(f"{y}_{z}") for y in ("key", "label", "n", "place")]) for x, z in ((indexed, "a"), (placed, "b")))
    rest = 1 + F.least(F.col("n_a") - 1 - F.col("place_a"), F.col("n_b") - 1 - F.col("place_b"))
    fits = (F.struct("n_a", "key_a") < F.struct("n_b", "key_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("n_a") >= near * F.col("n_b"))
    met = a.join(b, "token").where(fits & (rest >= near / (1 + near) * (F.col("n_a") + F.col("n_b"))))
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def _star(members: DataFrame, seed: int, per_pivot: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket and the pivot of their part; a part has about ``per_pivot`` members.

    ``members``: band, size, key, label. Pairs of one class are left out. Every member is in one pair a bucket."""
    part = F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("size") / per_pivot))
    parts = members.withColumn("part", part)
    pivots = parts.groupBy("band", "part").agg(F.min_by(F.struct("key", "label"), F.xxhash64("key", F.lit(-seed))).alias("pivot"))
    met = parts.join(pivots, ["band", "part"]).where(F.col("label") != F.col("pivot.label"))
    return met.select(F.least("key", "pivot.key").alias("a"), F.greatest("key", "pivot.key").alias("b")).distinct()


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the classes that ``links`` (a, b) of keys make of the old ones; buckets of one class are left out."""
    of = members.select("key", "label").distinct()
    ends = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y")
    classes = components(stored(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())).select(F.col("node").alias("label"), "component")
    named = stored(members.join(classes, "label", "left").select("band", "size", "key", F.coalesce("component", "label").alias("label")))
    several = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    return stored(named.join(several, "band"))


def shingle_links(rows: DataFrame, lows: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) of keys whose components are those of all similar pairs that share a band.

    Fingerprints of the trie join link first, and what they link is checked on the sets; bands and the prefix
    join then add the similar pairs whose fingerprints differ in more bits."""
    marked = stored(_marked(rows.select("key", "_text")).dropDuplicates(["key"]))
    linked = stored(trie_pairs(marked.select("key", "simhash")))
    buckets = stored(marked.select("key", F.explode("members").alias("band")))
    shared = buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(buckets.join(shared, "band").select("band", "size", "key", F.col("key").alias("label")))
    used = members.select("key").unionByName(linked.select(F.explode(F.array("a", "b")).alias("key")))
    sets = _described_once(used, rows, lows)
    links = [stored(_confirmed(linked, sets, least))]
    members = _relabelled(members, links[0])
    # a few partners in every bucket make one class of a large group; each round costs a pair a member
    for seed, per_pivot in enumerate(PARTS, 1):
        links.append(stored(_confirmed(stored(_star(members, seed, per_pivot)), sets, least)))
        members = _relabelled(members, links[-1])
    open_ = members.select("key", "label").distinct()
    left = stored(sets.join(open_.select("key"), "key", "left_semi"))
    links.append(_confirmed(stored(prefix_pairs(left, stored(open_), least)), left, least))
    return reduce(DataFrame.unionByName, links)


def similar_representatives(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One document of each class of similar texts: the row with the smallest id, null only if no other is there."""
    rows = documents.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("_text"))
    lows = stored(rows.groupBy("key").agg(F.min("_id").alias("low")))
    classes = components(stored(shingle_links(rows, lows, least))).withColumnRenamed("node", "key")
    named = lows.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = stored(named.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("first")))
    low, of, own = free_name(documents, "_low", "_of", "_own")
    kept = first.select(F.col("first.low").alias(low), F.col("first.key").alias(of))
    found = documents.withColumn(own, text_key(F.col(text))).join(kept, F.col(doc_id).eqNullSafe(F.col(low)) & (F.col(own) == F.col(of)))
    return found.dropDuplicates([low, of]).select(*documents.columns)
