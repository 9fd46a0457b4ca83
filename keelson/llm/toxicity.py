"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, pairs of neighbours and pairs with one word between them, hashed
into a fixed number of coordinates and counted once. Learning takes a bounded sample of labelled
rows; its shards are trained by FTRL in parallel and their state is mixed after every round
(iterative parameter mixing). Per-coordinate rates adapt to rare words, the L1 term leaves most
weights at zero, and what is broadcast for scoring is the short list of non-zero weights.

Cases: null and empty texts have no features and score by the bias; long texts are used whole;
several labels of one id count as toxic if one does; unlabelled tables give the score 0 for every
text; a null id is never learned from and not held out; equal rows are scored alike."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from keelson.llm.common import bounded_batches, map_columns, stored, worker_cache
from keelson.registry import query

SAMPLE_ROWS = 16_000  # labelled rows that are learned from, at most
CACHE_WORDS = 200_000
BLOCK = 1 << 14  # coordinates of a state that travel as one row


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the model and its training; ``shards`` does not depend on the cluster. A round is
    ``passes`` over each shard, after which the states are mixed."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    shards: int = 4
    rounds: int = 2
    passes: int = 2


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Sorted distinct coordinates of a text; the last coordinate, 2**bits, is the bias."""
    known = worker_cache("toxicity words", dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    bias = np.array([1 << bits], np.int64)
    words = text.lower().split() if text else []
    if not words:
        return bias
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    # a second hash makes the coordinate of a pair; near and skipping pairs are told apart
    near = (h[:-1] * mix + h[1:]) * mix
    skip = (h[:-2] * mix + h[2:] + np.uint64(1)) * mix
    coordinates = np.concatenate([h, near, skip]) >> np.uint64(64 - bits)
    return np.concatenate([np.unique(coordinates).astype(np.int64), bias])


def weights_of(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    """Closed form of the proximal step: zero within the L1 ball."""
    w = (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= p.l1, 0.0, w)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, p: Ftrl) -> None:
    """One pass of per-coordinate FTRL over the rows, in place."""
    for at, y in zip(rows, labels, strict=True):
        zi, ni = z[at], n[at]
        w = weights_of(zi, ni, p)
        g = sigmoid(w.sum()) - y
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / p.alpha * w
        n[at] = grown


def _pack(at: np.ndarray) -> bytes:
    """Differences of sorted coordinates by byte planes: the upper planes are zeros and compress away."""
    return np.ascontiguousarray(np.diff(at, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel(), dtype=np.int64)


def _fitter(turn: int, p: Ftrl):
    """Trains one shard from the mixed state of the round before, which comes in blocks of coordinates."""

    def fit(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        size = (1 << p.bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        for block, zs, ns in zip(state["block"], state["z"], state["n"], strict=True):
            at = slice(block * BLOCK, min(size, (block + 1) * BLOCK))
            z[at], n[at] = np.frombuffer(zs, "<f4"), np.frombuffer(ns, "<f4")
        rows, labels = [_unpack(x) for x in group["at"]], group["toxic"].to_numpy(float)
        if not rows:
            return pd.DataFrame({"block": [], "shard": [], "z": [], "n": []})
        for lap in range(p.passes):
            # the order within a shard does not depend on how rows arrive, and changes every time
            order = np.argsort([xxhash.xxh64_intdigest(str(x), seed=turn * p.passes + lap) for x in group["doc_id"]], kind="stable")
            train([rows[i] for i in order], labels[order], z, n, p)
        blocks = range(0, size, BLOCK)
        return pd.DataFrame({
            "block": [x // BLOCK for x in blocks], "shard": group["shard"].iloc[0],
            **{k: [v[x : x + BLOCK].astype("<f4").tobytes() for x in blocks] for k, v in (("z", z), ("n", n))},
        })

    return fit


def _mixed(states: pd.DataFrame) -> pd.DataFrame:
    """The mean of the shards' states for one block."""
    states = states.sort_values("shard")

    def mean(column: str) -> bytes:
        parts = [np.frombuffer(x, "<f4") for x in states[column]]
        return (np.sum(parts, axis=0, dtype="<f4") / np.float32(len(parts))).astype("<f4").tobytes()

    return pd.DataFrame({"block": states["block"].iloc[:1], "z": [mean("z")], "n": [mean("n")]})


STATE = "block int, z binary, n binary"


def learn(labelled: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the non-zero weights, from a bounded frame (doc_id, text, toxic).

    States stay on the executors, in blocks of coordinates; the driver gets the sparse weights only."""
    spark = labelled.sparkSession
    bits, size = p.bits, (1 << p.bits) + 1

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array([_pack(features(x, bits)) for x in batch.column(0).to_pylist()], pa.binary())]

    shard = labelled.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(p.shards)).cast("int"))
    made = stored(map_columns(shard, [F.col("text").cast("binary")], [StructField("at", BinaryType())], compute, ["doc_id", "toxic", "shard"]))
    state = spark.createDataFrame([], STATE)
    for turn in range(p.rounds):
        given = state.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(p.shards - 1))))
        trained = made.groupBy("shard").cogroup(given.groupBy("shard")).applyInPandas(_fitter(turn, p), "block int, shard int, z binary, n binary")
        state = stored(trained.groupBy("block").applyInPandas(_mixed, STATE))

    def sparse(batches):
        for batch in batches:
            found = []
            for block, z, n in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                w = weights_of(np.frombuffer(z, "<f4"), np.frombuffer(n, "<f4"), p)
                at = np.flatnonzero(w)
                found.append(((at + block * BLOCK).astype("<i4").tobytes(), w[at].astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["at", "w"])

    parts = state.orderBy("block").select("block", "z", "n").mapInArrow(sparse, "at binary, w binary").collect()  # non-zero weights, below ``size``
    at, w = (b"".join(bytes(r[x]) for r in parts) for x in ("at", "w"))
    at, w = np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(w, "<f8")
    assert len(at) <= size
    return at, w


def sample(documents: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled ids for which ``allowed`` holds, dealt by a hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a first cut by hash leaves about twice the rows wanted, so that few rows meet in the sort
    share = min(1.0, 2 * rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    # of repeated ids one text is enough
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def score(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], p: Ftrl = Ftrl(), text: str = "text") -> DataFrame:
    """Adds ``score``, the modelled probability that a text is toxic."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # sparse, below 2**bits
    bits, none = p.bits, not len(weights[0])

    def compute(batch: pa.RecordBatch) -> list:
        dense = _dense(shared, bits)
        return [pa.array([0.0 if none else float(sigmoid(dense[features(x, bits)].sum())) for x in batch.column(0).to_pylist()], pa.float64())]

    return map_columns(documents, [F.col(text).cast("binary")], [StructField("score", DoubleType())], compute, documents.columns)


_DENSE: list = []


def _dense(shared, bits: int) -> np.ndarray:
    """The weights as one array, made once per worker and model."""
    if not _DENSE or _DENSE[0] is not shared.value:
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        _DENSE[:] = [shared.value, dense]
    return _DENSE[1]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of the documents with held_out, score and predicted."""
    weights = learn(sample(documents, labels, ~held_out(), rows), p)
    scored = score(documents.drop("held_out", "predicted"), weights, p)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


@query("op1_toxicity_ftrl")
def op1_toxicity_ftrl(t):
    return toxicity(t.documents.select("doc_id", "text"), t.labels).select("doc_id", "held_out", "score", "predicted")
