"""Byte-level BPE by corpus-level merge replay.

All texts of an Arrow batch are one corpus: their distinct pre-tokens are laid out as byte symbols,
an inverted index from symbol pair to places is built once, and merges are applied in rank order to
every place of a pair, updating only the touched neighbours. Pre-tokens are independent, so the ids
do not depend on how texts are dealt over batches and tasks, and a lost task is simply run again.

Cases: a null text is encoded as an empty one (no ids); texts of any length are encoded whole; equal
rows give equal ids; columns of the input with the name of an added one give way to it."""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from keelson.llm.common import bounded_batches, map_columns, worker_cache
from keelson.registry import query

BATCH_ROWS = 4_096  # texts whose pre-tokens are replayed together
REPLAY_WORDS = 400_000  # distinct pre-tokens replayed together, at most
CACHE_WORDS = 150_000  # encoded pre-tokens in a generation of a worker's cache


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left rank << 32 | right rank to the rank of the joined token, for every split of a token in two."""
    return {
        ranks[token[:i]] << 32 | ranks[token[i:]]: rank
        for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
    }


def replay(words: list[bytes], single: list[int], merges: dict[int, int]) -> list[list[int]]:
    """Ids of every word: merges replayed over all words together. ``single``: ranks of the bytes.

    Symbols of all words stand in one array; ``after`` and ``before`` link the live ones of a word.
    ``waiting`` maps a rank to the left places of pairs that merge to it. The lowest waiting rank goes
    first, its places from left to right; a merge that makes a pair of lower rank in its word puts
    off the word's later places until that pair has gone, as a word on its own would do."""
    symbols: list[int] = []
    word_of: list[int] = []
    first: list[int] = []
    for number, word in enumerate(words):
        first.append(len(symbols))
        symbols += [single[x] for x in word]
        word_of += [number] * len(word)
    size = len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    for start, word in zip(first, words, strict=True):
        if word:
            before[start] = -1
            after[start + len(word) - 1] = -1
    waiting: dict[int, list[int]] = {}
    heap: list[int] = []
    joined = merges.get
    for at in range(size):
        if (right := after[at]) >= 0 and (rank := joined(symbols[at] << 32 | symbols[right])) is not None:
            if rank in waiting:
                waiting[rank].append(at)
            else:
                waiting[rank] = [at]
    heap = list(waiting)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = waiting.pop(rank)
        places.sort()
        put_off: set[int] = set()
        later: list[int] = []
        for at in places:
            # a symbol that was merged into its left neighbour is -1, and joins with nothing
            if (right := after[at]) < 0 or joined(symbols[at] << 32 | symbols[right]) != rank:
                continue
            if put_off and word_of[at] in put_off:
                later.append(at)
                continue
            symbols[at], symbols[right] = rank, -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                if (made := joined(rank << 32 | symbols[beyond])) is not None:
                    if made in waiting:
                        waiting[made].append(at)
                    else:
                        waiting[made] = [at]
                        heapq.heappush(heap, made)
                    if made < rank:
                        put_off.add(word_of[at])
            if (previous := before[at]) >= 0 and (made := joined(symbols[previous] << 32 | rank)) is not None:
                if made in waiting:
                    waiting[made].append(previous)
                else:
                    waiting[made] = [previous]
                    heapq.heappush(heap, made)
                if made < rank:
                    put_off.add(word_of[at])
        if later:
            if rank in waiting:
                waiting[rank] += later
            else:
                waiting[rank] = later
                heapq.heappush(heap, rank)
    out = []
    for start, word in zip(first, words, strict=True):
        ids, at = [], start if word else -1
        while at >= 0:
            ids.append(symbols[at])
            at = after[at]
        out.append(ids)
    return out


class Merges:
    """The merge table as sorted arrays, with the ranks of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        table = merge_table(ranks)
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or -1."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], -1)


def replay_many(words: list[bytes], merges: Merges) -> list[bytes]:
    """Packed ids (32-bit little-endian) of every word, each merge applied to all its places at once.

    The same replay as ``replay``, on arrays. All places of the lowest waiting rank are merged in one
    step, of overlapping ones every other from the left. Should a step make a pair of lower rank, the
    words concerned are replayed alone, because their other places should have waited for it."""
    if not len(merges.keys):
        return [merges.single[np.frombuffer(w, np.uint8)].astype("<i4").tobytes() for w in words]
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = merges.single[np.frombuffer(b"".join(words), np.uint8)]
    size, ends = len(symbols), np.cumsum(lengths)
    full = lengths > 0
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    after[ends[full] - 1] = -1
    before[(ends - lengths)[full]] = -1
    word_of = np.repeat(np.arange(len(words)), lengths)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    alone: set[int] = set()

    def wait(places: np.ndarray, done: int) -> None:
        """Files places, whose right neighbours exist, under the ranks of their pairs."""
        ranks = merges.of(symbols[places], symbols[after[places]])
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        low = 0
        for high in cuts:
            rank = int(ranks[low])
            if rank >= 0:
                if rank < done:
                    alone.update(word_of[places[low:high]].tolist())
                if rank in waiting:
                    waiting[rank].append(places[low:high])
                else:
                    waiting[rank] = [places[low:high]]
                    heapq.heappush(heap, rank)
            low = high

    if size:
        first = np.flatnonzero(after >= 0)
        if len(first):
            wait(first, -1)
    while heap:
        rank = heapq.heappop(heap)
        parts = waiting.pop(rank)
        places = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
        right = after[places]
        live = (right >= 0) & (merges.of(symbols[places], symbols[right]) == rank)
        if not live.all():
            places, right = places[live], right[live]
            if not len(places):
                continue
        touch = right[:-1] == places[1:]
        if touch.any():
            number = np.arange(len(places))
            run = number.copy()
            run[1:][touch] = 0
            keep = (number - np.maximum.accumulate(run)) % 2 == 0
            places, right = places[keep], right[keep]
        beyond = after[right]
        symbols[places], symbols[right] = rank, -1
        after[places] = beyond
        more = beyond >= 0
        before[beyond[more]] = places[more]
        previous = before[places]
        changed = np.concatenate([places[more], previous[previous >= 0]])
        if len(changed):
            wait(changed, rank)
    live = symbols >= 0
    data = symbols[live].astype("<i4").tobytes()
    bounds = [0, *(4 * np.cumsum(np.bincount(word_of[live], minlength=len(words)))).tolist()]
    out = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    if alone:
        single, table = merges.single.tolist(), dict(zip(merges.keys.tolist(), merges.ranks.tolist(), strict=True))
        for number, ids in zip(sorted(alone), replay([words[i] for i in sorted(alone)], single, table), strict=True):
            out[number] = array("i", ids).tobytes()
    return out


@lru_cache(1)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _encode(texts: list[str | None], shared: Broadcast, pattern: str, run: str) -> list[bytes]:
    """Ids of every text as little-endian 32-bit integers."""
    # encoded pre-tokens that this worker keeps: a young and an old generation
    generations = worker_cache(run, lambda: [{}, {}])
    split, number = _splitter(pattern), {}
    place = number.setdefault
    pieces = [array("i", [place(w, len(number)) for w in split(x)]) if x else () for x in texts]
    if len(generations[0]) + len(number) > CACHE_WORDS:
        generations[:] = [{}, generations[0]]
    young, old = generations
    fresh = []
    for word in number:
        if word not in young:
            ids = old.get(word)
            if ids is None:
                fresh.append(word)
            else:
                young[word] = ids
    for start in range(0, len(fresh), REPLAY_WORDS):
        part = fresh[start : start + REPLAY_WORDS]
        young.update(zip(part, replay_many([x.encode() for x in part], shared.value), strict=True))
    find = [young[w] for w in number].__getitem__
    return [b"".join(map(find, x)) for x in pieces]


def _listed(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (1 + max(ranks.values(), default=-1))
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def bpe_encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) to every row."""
    spark = documents.sparkSession
    bounded_batches(spark, BATCH_ROWS)
    shared = spark.sparkContext.broadcast(Merges(ranks))  # of a vocabulary of bounded size
    run = uuid.uuid4().hex

    def compute(batch: pa.RecordBatch) -> list:
        return [_listed(_encode(batch.column(0).to_pylist(), shared, pattern, run))]

    return map_columns(documents, [F.col(text)], [StructField("ids", ArrayType(IntegerType()))], compute, documents.columns)


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (bytes) to every row; null ids decode to no bytes."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(_tokens(ranks))

    def compute(batch: pa.RecordBatch) -> list:
        find = shared.value.__getitem__
        return [pa.array([b"".join(map(find, row.tolist())) for row in _rows(batch.column(0))], pa.binary())]

    return map_columns(encoded, [F.col(ids)], [StructField("decoded", BinaryType())], compute, encoded.columns)


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Every list of the column as an array; a null is an empty one."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    full = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[i] : offsets[i + 1]] if full[i] else values[:0] for i in range(len(column))]


def bpe_round_trip(documents: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Adds ids, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256
    (of what the ids decode to): ``bpe_encode`` and ``bpe_decode`` in one pass of one worker."""
    spark = documents.sparkSession
    bounded_batches(spark, BATCH_ROWS)
    shared = spark.sparkContext.broadcast(Merges(ranks))
    named = spark.sparkContext.broadcast(_tokens(ranks))
    run = uuid.uuid4().hex

    def compute(batch: pa.RecordBatch) -> list:
        packed, find = _encode(batch.column(0).to_pylist(), shared, pattern, run), named.value.__getitem__
        digest = lambda data: hashlib.sha256(data).hexdigest()
        decoded = [digest(b"".join(map(find, np.frombuffer(x, "<u4").tolist()))) for x in packed]
        return [_listed(packed), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([digest(x) for x in packed], pa.string()), pa.array(decoded, pa.string())]

    added = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return map_columns(documents, [F.col(text)], added, compute, documents.columns)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed public tokenizer."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query("op4_byte_bpe")
def op4_byte_bpe(t):
    ranks, pattern = public_vocabulary()
    return bpe_round_trip(t.documents.select("doc_id", "text"), ranks, pattern).drop("text", "ids")
