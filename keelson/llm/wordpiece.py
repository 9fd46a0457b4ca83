"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link to the node that stands for what
is left after the greedy pieces so far have been popped, and the number of pieces popped on the way,
both computed once. A word is then counted in one pass over its bytes, without building pieces.

Cases: a null or empty text has no words and no tokens; bytes that no piece covers count as one
token each; words of any length take linear time; equal rows get equal counts."""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from keelson.llm.bpe import public_vocabulary
from keelson.llm.common import bounded_batches, map_columns, worker_cache
from keelson.registry import query

CACHE_WORDS = 200_000


@dataclass
class Automaton:
    """``children``: node * 256 + byte to node; ``failure`` and ``popped`` by node; node 0 is the root."""

    children: dict[int, int]
    failure: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of a word."""
        children, failure, popped = self.children, self.failure, self.popped
        node, tokens = 0, 0
        for byte in word:
            while (step := children.get(node * 256 + byte)) is None:
                if node == 0:
                    tokens += 1  # no piece begins with this byte
                    break
                tokens += popped[node]
                node = failure[node]
            else:
                node = step
        while node:
            tokens += popped[node]
            node = failure[node]
        return tokens


def build_automaton(pieces) -> Automaton:
    """Trie, failure links and popped-token counts of a vocabulary of byte strings.

    For a node that is a piece, the piece itself is popped and the root is left. For another node
    the failure chain of its parent is followed, popping pieces, until a node can take the last
    byte; single bytes outside the vocabulary count as a piece, so every chain ends at the root."""
    children: dict[int, int] = {}
    piece, parent, byte_of, order = [False], [0], [0], deque()
    for text in sorted(set(pieces)):
        node = 0
        for byte in text:
            key = node * 256 + byte
            if key not in children:
                children[key] = len(piece)
                piece.append(False)
                parent.append(node)
                byte_of.append(byte)
            node = children[key]
        if node:
            piece[node] = True
    below: list[list[int]] = [[] for _ in piece]
    for node in range(1, len(piece)):
        below[parent[node]].append(node)
    failure, popped = [0] * len(piece), [0] * len(piece)
    order.append(0)
    while order:
        node = order.popleft()
        order.extend(below[node])
        if node == 0:
            continue
        if piece[node]:
            failure[node], popped[node] = 0, 1
            continue
        if parent[node] == 0:
            failure[node], popped[node] = 0, 1  # a first byte that is no piece: a token of its own
            continue
        at, tokens, byte = parent[node], 0, byte_of[node]
        while True:
            tokens += popped[at]
            at = failure[at]
            step = children.get(at * 256 + byte)
            if step is not None:
                failure[node], popped[node] = step, tokens
                break
            if at == 0:
                failure[node], popped[node] = 0, tokens + 1
                break
    return Automaton(children, failure, popped)


def token_counts(documents: DataFrame, pieces, text: str = "text", prefix: bytes = b" ") -> DataFrame:
    """Adds n_words and n_tokens; every whitespace-separated word is matched with ``prefix`` before it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(build_automaton(pieces))  # a vocabulary of bounded size
    run = uuid.uuid4().hex

    def compute(batch: pa.RecordBatch) -> list:
        counts, count = worker_cache(run, dict), shared.value.count
        words, tokens = [], []
        for body in batch.column(0).to_pylist():
            found = body.split() if body else []
            total = 0
            for word in found:
                n = counts.get(word)
                if n is None:
                    if len(counts) >= CACHE_WORDS:
                        counts.clear()
                    n = counts[word] = count(prefix + word)
                total += n
            words.append(len(found))
            tokens.append(total)
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    added = [StructField("n_words", LongType()), StructField("n_tokens", LongType())]
    return map_columns(documents, [F.col(text).cast("binary")], added, compute, documents.columns)


@query("op3_wordpiece_counts")
def op3_wordpiece_counts(t):
    return token_counts(t.documents.select("doc_id", "text"), public_vocabulary()[0]).drop("text")
