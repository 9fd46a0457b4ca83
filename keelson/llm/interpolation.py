"""Language-model scores by deleted interpolation.

The probability of a token after another is a mixture of the bigram, unigram and uniform estimates
of maximum likelihood. The weights depend on how frequent the context is (a bucket per octave of its
count) and are learned by expectation-maximisation on a deleted part of the training texts, whose
own counts are taken off before they are predicted.

Counts move in packed form. A task packs its texts into blocks of tokens, with word numbers of the
block's own. Each block asks for the distinct words and bigrams it holds, sorted and dealt over
shards by hash; a shard adds up what the blocks counted and answers every block with the totals in
the same order. A word of any frequency is thus one entry per block. Words are compared as bytes,
bigrams by 56 bits of hash (of 10^12 different bigrams one in 70,000 meets another's count).

Cases: a null text is an empty one, which is the end token alone; long texts are used whole; a null
id is neither held out nor learned from; equal rows are scored alike; with nothing to learn from, N
and V are zero, the weights are equal and every token has a third of the uniform estimate, one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from keelson.llm.common import bounded_batches, stored
from keelson.registry import query

BLOCK_TOKENS = 1_000_000  # tokens of a block, at least one text
SHARD_TOKENS = 256_000  # tokens per shard: sets the number of shards
STEPS = 4  # cells per octave in the statistics of the weights
OCTAVES = 48
ROUNDS = 60  # of expectation-maximisation
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCK = "block long, deleted boolean, doc_ids array<bigint>, folds binary, lengths binary, tokens binary, words binary"


def _pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, so that the planes of zeros compress away."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Block:
    """Texts of one kind, with numbers for their words; word 0 is the end of a text."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0}
        self.ids: list[int | None] = []
        self.folds: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, fold: int, text: bytes | None) -> None:
        number = self.number
        words = text.lower().split() if text else []
        part = np.array([number.setdefault(w, len(number)) for w in words] + [0], np.int32)
        self.ids.append(doc_id)
        self.folds.append(fold)
        self.parts.append(part)
        self.size += len(part)

    def row(self, block: int, deleted: bool) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in self.parts], "<i4")
        values = [[block], [deleted], pa.array([self.ids], pa.list_(pa.int64())), [np.array(self.folds, np.int8).tobytes()], [lengths.tobytes()], [np.concatenate(self.parts).astype("<i4").tobytes()], [b"\n".join(self.number)]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], names=["block", "deleted", "doc_ids", "folds", "lengths", "tokens", "words"])


def pack_blocks(batches: Iterator[pa.RecordBatch], deleted_fold: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts of a task; those of the deleted fold have blocks of their own."""
    task, made = TaskContext.get().partitionId(), 0
    open_ = {False: Block(), True: Block()}
    for batch in batches:
        for doc_id, fold, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            kind = fold == deleted_fold
            open_[kind].add(doc_id, fold, text)
            if open_[kind].size >= size:
                yield open_[kind].row(task << 32 | made, kind)
                open_[kind], made = Block(), made + 1
    for kind, block in open_.items():
        if block.size:
            yield block.row(task << 32 | made, kind)
            made += 1


class Opened:
    """A block's tokens with its distinct words and bigrams, both in the order of requests."""

    def __init__(self, row: dict, shards: int):
        self.doc_ids, self.lengths = row["doc_ids"], np.frombuffer(row["lengths"], "<i4")
        self.folds = np.frombuffer(row["folds"], np.int8)
        self.tokens = np.frombuffer(row["tokens"], "<i4")
        self.words = row["words"].split(b"\n")
        digest = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self.word_shard = (digest % np.uint64(shards)).astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        # the context of a text's first token is the end of a text
        self.context = np.r_[np.int32(0), self.tokens[:-1]]
        self.context[starts] = 0
        mixed = (digest[self.context] * K1 + digest[self.tokens]) * K2
        mixed ^= mixed >> np.uint64(29)
        self.grams, self.gram_of = np.unique((mixed * K1 >> np.uint64(8)).astype(np.int64), return_inverse=True)
        # shards hold equal ranges of the sorted hashes
        self.gram_cut = np.searchsorted(self.grams, [(1 << 56) * s // shards for s in range(shards + 1)])

    def places(self, shard: int) -> np.ndarray:
        return np.flatnonzero(self.word_shard == shard)


def requests(batches: Iterator[pa.RecordBatch], held: int, shards: int) -> Iterator[pa.RecordBatch]:
    """What each block asks of each shard, with its own counts in texts that may be learned from."""
    for batch in batches:
        for row in batch.to_pylist():
            x = Opened(row, shards)
            learned = np.repeat((x.folds != held) & (x.folds >= 0), x.lengths)
            words = np.bincount(x.tokens[learned], minlength=len(x.words))
            grams = np.bincount(x.gram_of[learned], minlength=len(x.grams))
            order = np.argsort(x.word_shard, kind="stable")
            cut = np.searchsorted(x.word_shard[order], np.arange(shards + 1))
            out: dict[str, list] = {k: [] for k in ("shard", "block", "deleted", "words", "word_counts", "grams", "gram_counts")}
            for s in range(shards):
                at, low, high = order[cut[s] : cut[s + 1]], x.gram_cut[s], x.gram_cut[s + 1]
                if len(at) or high > low:
                    found = x.grams[low:high]
                    for k, v in zip(out, (s, row["block"], row["deleted"], b"\n".join(x.words[i] for i in at), _pack(words[at]), _pack(np.diff(found, prepend=0)), _pack(grams[low:high])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("deleted", pa.bool_()), *((k, pa.binary()) for k in list(out)[3:])]))


def add_up(table):
    """The totals of a shard, given back to every block that asked, in the order of its request."""
    rows = table.to_pylist()
    number: dict[bytes, int] = {}
    # an empty list of words and the end token alone look alike; the counts tell them apart
    asked = []
    for r in rows:
        counts = _unpack(r["word_counts"])
        words = r["words"].split(b"\n") if len(counts) else []
        asked.append((np.array([number.setdefault(w, len(number)) for w in words], np.int64), counts))
    learned, taken = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for (at, counts), r in zip(asked, rows, strict=True):
        learned[at] += counts  # the words of a request are distinct
        if r["deleted"]:
            taken[at] += counts
    grams = [np.cumsum(_unpack(r["grams"])) for r in rows]
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    gram_learned, gram_taken = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    ends = np.cumsum([len(g) for g in grams])
    out = {k: [] for k in ("block", "deleted", "shard", "words", "words_taken", "grams", "grams_taken", "total", "taken", "distinct")}
    at_gram = [place[e - len(g) : e] for e, g in zip(ends, grams, strict=True)]
    for at, r in zip(at_gram, rows, strict=True):
        counts = _unpack(r["gram_counts"])
        gram_learned[at] += counts
        if r["deleted"]:
            gram_taken[at] += counts
    for n, ((at, _), g, r) in enumerate(zip(asked, at_gram, rows, strict=True)):
        d = r["deleted"]
        once = n == 0  # sums over the shard stand in one of its rows
        values = (r["block"], d, r["shard"], _pack(learned[at]), _pack(taken[at]) if d else b"", _pack(gram_learned[g]), _pack(gram_taken[g]) if d else b"",
                  int(learned.sum()) if once else 0, int(taken.sum()) if once else 0, int((learned > 0).sum()) if once else 0)
        for k, v in zip(out, values, strict=True):
            out[k].append(v)
    kinds = {"deleted": pa.bool_(), "words": pa.binary(), "words_taken": pa.binary(), "grams": pa.binary(), "grams_taken": pa.binary()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


ANSWER = "block long, deleted boolean, shard long, words binary, words_taken binary, grams binary, grams_taken binary, total long, taken long, distinct long"


def _gathered(blocks, answers, shards: int) -> tuple[Opened, dict[str, np.ndarray]]:
    """A block and its totals, put back into the block's own order of words and bigrams."""
    x = Opened(blocks.to_pylist()[0], shards)
    deleted = blocks.column("deleted")[0].as_py()
    got = {"words": np.zeros(len(x.words), np.int64), "grams": np.zeros(len(x.grams), np.int64)}
    if deleted:
        got |= {"words_taken": np.zeros(len(x.words), np.int64), "grams_taken": np.zeros(len(x.grams), np.int64)}
    order = np.argsort(x.word_shard, kind="stable")
    cut = np.searchsorted(x.word_shard[order], np.arange(shards + 1))
    for r in answers.to_pylist():
        s = r["shard"]
        for name, values in got.items():
            at = order[cut[s] : cut[s + 1]] if name.startswith("words") else slice(x.gram_cut[s], x.gram_cut[s + 1])
            values[at] = _unpack(r[name])
    return x, got


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Octave of the context's count; 0 for an unseen context."""
    return np.minimum(OCTAVES - 1, np.ceil(np.log2(np.maximum(count, 0) + 1))).astype(np.int64)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    b = np.broadcast_to(np.asarray(b, float), a.shape)
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _statistics(shards: int, total: int):
    """How often deleted tokens meet each (bucket, bigram estimate, unigram estimate), by cells of a quarter octave."""

    def count(blocks, answers):
        x, got = _gathered(blocks, answers, shards)
        words, grams = got["words"] - got["words_taken"], got["grams"] - got["grams_taken"]
        context = words[x.context]
        estimates = _ratio(grams[x.gram_of], context), _ratio(words[x.tokens], total)
        cells = [np.where(p > 0, np.round(STEPS * np.log2(np.where(p > 0, p, 1))), 1).astype(np.int64) for p in estimates]  # 1: never seen
        keys, n = np.unique(np.stack([context_bucket(context), *cells]), axis=1, return_counts=True)
        return pa.table({"bucket": keys[0], "bigram": keys[1], "unigram": keys[2], "n": n.astype(np.int64)})

    return count


def mixture_weights(cells: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every bucket by expectation-maximisation.

    A bucket without deleted tokens takes the weights of all buckets together; no weight is zero."""
    p = np.stack([*(np.where(cells[k] > 0, 0.0, np.exp2(cells[k] / STEPS)) for k in ("bigram", "unigram")), np.full(len(cells), uniform)]).astype(float)

    def learned(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS if n.sum() else 0):
            share = w[:, None] * p
            share /= np.maximum(share.sum(axis=0), 1e-300)
            w = (share * n).sum(axis=1) / n.sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    n = cells["n"].to_numpy(float)
    out = np.tile(learned(p, n), (OCTAVES, 1))
    for b in np.unique(cells["bucket"]):
        at = (cells["bucket"] == b).to_numpy()
        out[b] = learned(p[:, at], n[at])
    return out


def _scores(shards: int, total: int, distinct: int, weights: np.ndarray):
    def score(blocks, answers):
        x, got = _gathered(blocks, answers, shards)
        known, context = got["words"][x.tokens], got["words"][x.context]
        w = weights[context_bucket(context)]
        model = w[:, 0] * _ratio(got["grams"][x.gram_of], context) + w[:, 1] * _ratio(known, total) + w[:, 2] / (distinct + 1)
        starts = np.cumsum(x.lengths) - x.lengths
        base = np.log10((known + 1) / (total + distinct + 1))
        sums = [np.add.reduceat(v, starts) for v in (base, np.log10(model), (known > 0).astype(np.int64))]
        return pa.table({
            "doc_id": pa.array(x.doc_ids, pa.int64()), "n_tokens": x.lengths.astype(np.int64), "n_known": sums[2],
            "train_tokens": np.full(len(starts), total, np.int64), "base_score": sums[0], "score": sums[1],
        })

    return score


def language_scores(documents: DataFrame, fold: Column, held: int, deleted: int, text: str = "text", doc_id: str = "doc_id",
                    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``fold``: small number of a row; rows of fold ``held`` are only scored, the fold ``deleted`` of
    the others is what the mixture weights are learned on."""
    bounded_batches(documents.sparkSession)
    given = documents.select(F.col(doc_id).cast("bigint"), F.coalesce(fold, F.lit(-1)).cast("int"), F.col(text).cast("binary"))
    blocks = stored(given.mapInArrow(lambda batches: pack_blocks(batches, deleted, block_tokens), BLOCK))
    tokens = blocks.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0)).alias("n")).first()["n"] // 4
    shards = max(1, math.ceil(tokens / shard_tokens))
    asked = blocks.mapInArrow(lambda batches: requests(batches, held, shards), "shard long, block long, deleted boolean, words binary, word_counts binary, grams binary, gram_counts binary")
    answers = stored(asked.groupBy("shard").applyInArrow(add_up, ANSWER))
    sums = answers.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", "taken", "distinct")]).first()
    total, distinct = sums["total"], sums["distinct"]

    def together(made, schema: str, only: str = "true") -> DataFrame:
        left, right = blocks.where(only).groupBy("block"), answers.where(only).groupBy("block")
        return left.cogroup(right).applyInArrow(made, schema)

    cells = together(_statistics(shards, total - sums["taken"]), "bucket long, bigram long, unigram long, n long", "deleted")
    # at most 48 buckets by some hundred cells a side, whatever the corpus
    summed = cells.groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture_weights(summed, 1 / (distinct + 1))
    return together(_scores(shards, total, distinct, weights), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def crc_fold(doc_id: str = "doc_id", folds: int = 7) -> Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds).cast("int")


@query("op5_deleted_interpolation")
def op5_deleted_interpolation(t):
    scored = language_scores(t.documents.select("doc_id", "text"), crc_fold(), held=2, deleted=3)
    return scored.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
