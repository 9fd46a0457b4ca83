"""Exact dedup: a tree-merge of sorted digest runs.

Every partition of the documents becomes a run: one entry for each text it holds, sorted by the
leading 64 bits of the text's SHA-256, with the number of rows and the row that would stay. Runs are
merged along binomial trees, one tree for each range of digests: in a round the nodes that differ in
one digit of their number exchange runs, each takes the digests with its own digit and merges what it
gets (FAN runs, which is three binomial steps at once). After the last round a node holds all entries
of its range. Entries with equal leading bits are merged only if all 256 bits agree, at every level;
the best row is chosen again at every level. A node holds about NODE_ROWS entries, however many rows
a text has, because copies are counted in the first run already.

Texts are equal if they are the same bytes after white space (``[\\x20\\x09-\\x0D]``) is deleted. Of
equal texts the row with most code points in the original text stays, then the smallest id.

Cases: null, empty and blank texts are equal; ids may be of any type that has an order, a null id
comes last; of rows equal in id and length one stays; an empty table gives no rows; texts of any
length are used whole; bytes that are not UTF-8 are compared as they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from keelson.llm.common import free_name, stored
from keelson.registry import query

FAN = 8  # runs that meet in one round
NODE_ROWS = 500_000  # entries a node holds at the end, on average: sets the number of rounds
RUN_ROWS = 262_144  # entries of a first run
PIECE_ROWS = 32_768  # entries that travel as one row


@dataclass
class Run:
    """Entries sorted by digest: four big-endian words each, rows counted, and the row that would stay."""

    words: np.ndarray  # (n, 4) of uint64
    n: np.ndarray
    chars: np.ndarray
    row: np.ndarray
    id: pa.Array

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at: np.ndarray) -> Run:
        return Run(self.words[at], self.n[at], self.chars[at], self.row[at], self.id.take(pa.array(at)))

    def part(self, low: int, high: int) -> Run:
        return Run(self.words[low:high], self.n[low:high], self.chars[low:high], self.row[low:high], self.id.slice(low, high - low))


def words_of(sha: bytes) -> np.ndarray:
    return np.frombuffer(sha, ">u8").astype(np.uint64).reshape(-1, 4)


def merge(runs: list[Run]) -> Run:
    """One run of several: equal texts become one entry with the best of their rows."""
    every = Run(
        np.concatenate([r.words for r in runs]), *[np.concatenate([getattr(r, x) for r in runs]) for x in ("n", "chars", "row")],
        pa.chunked_array([r.id for r in runs]).combine_chunks(),
    )
    order = np.argsort(every.words[:, 0], kind="stable")  # a merge sort that keeps sorted stretches together
    sorted_ = every.words[order]
    same = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    if (~same & (sorted_[1:, 0] == sorted_[:-1, 0])).any():  # different texts share the leading bits
        order = np.lexsort(every.words.T[::-1])
        sorted_ = every.words[order]
        same = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    first = np.flatnonzero(np.r_[True, ~same])
    if len(first) == len(order):
        return every.take(order)
    count = np.add.reduceat(every.n[order], first)
    group = np.cumsum(np.r_[True, ~same]) - 1
    several = np.flatnonzero(np.diff(np.r_[first, len(order)])[group] > 1)
    at = order[several]
    # the rank puts ids of any type in order, null last
    rank = pc.rank(every.id.take(pa.array(at)), "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    order[several] = at[np.lexsort((every.row[at], rank, -every.chars[at], group[several]))]
    merged = every.take(order[first])
    merged.n = count
    return merged


def rounds_of(rows: int, node_rows: int = NODE_ROWS) -> int:
    """Rounds of exchange; there are FAN ** rounds nodes."""
    return max(2, math.ceil(math.log(max(1, rows / node_rows), FAN)))


def deal(run: Run, node: int, turn: int, rounds: int) -> Iterator[tuple[int, Run]]:
    """(node, run) for each digit that stands at place ``turn`` of the run's digests.

    Digests at a node agree in the digits before ``turn``, so those of one digit stand together."""
    weight = FAN ** (rounds - 1 - turn)
    place = (run.words[:, 0] >> np.uint64(64 - rounds * int(math.log2(FAN)))).astype(np.int64) // weight % FAN
    bounds = np.searchsorted(place, np.arange(FAN + 1))
    rest = node - node // weight % FAN * weight
    for digit in range(FAN):
        if bounds[digit] < bounds[digit + 1]:
            yield rest + digit * weight, run.part(bounds[digit], bounds[digit + 1])


def _pieces(dealt: Iterator[tuple[int, Run]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def lists(values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int64()))

    for node, run in dealt:
        for low in range(0, len(run), PIECE_ROWS):
            part = run.part(low, min(len(run), low + PIECE_ROWS))
            made = [pa.array([node], pa.int64()), pa.array([part.words.astype(">u8").tobytes()], pa.binary()), lists(part.n), lists(part.chars), lists(part.row), lists(part.id)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def _read(table: pa.Table) -> list[Run]:
    columns = [table.column(x).combine_chunks() for x in ("sha", "n", "chars", "row", "id")]
    return [Run(words_of(sha.as_py()), *[x.values.to_numpy().astype(np.int64) for x in (n, chars, row)], ids.values) for sha, n, chars, row, ids in zip(*columns, strict=True)]


def tree_merge(rows: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Texts that several rows have: sha, group_size, keep_id, keep_row.

    ``rows``: row (distinct), id, chars and sha (binary) of every document."""
    kind = rows.schema["id"].dataType
    rounds = rounds_of(rows.count(), node_rows)
    fields = [StructField("node", LongType()), StructField("sha", BinaryType()), *[StructField(x, ArrayType(LongType())) for x in ("n", "chars", "row")], StructField("id", ArrayType(kind))]
    travelling = StructType(fields)
    element = kind.simpleString()

    def piece_schema(id_type: pa.DataType) -> pa.Schema:
        many = pa.list_(pa.int64())
        return pa.schema([("node", pa.int64()), ("sha", pa.binary()), ("n", many), ("chars", many), ("row", many), ("id", pa.list_(id_type))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            run = merge(held)
            return _pieces(deal(run, (task + 7919 * number) % FAN**rounds, 0, rounds), piece_schema(run.id.type))

        for batch in batches:
            if not batch.num_rows:
                continue
            chars, row = (batch.column(x).to_numpy() for x in (1, 2))
            held.append(Run(words_of(b"".join(batch.column(3).to_pylist())), np.ones(len(row), np.int64), chars, row, batch.column(0)))
            size += batch.num_rows
            if size >= RUN_ROWS:
                yield from emit()
                number, held, size = number + 1, [], 0
        if held:
            yield from emit()

    def exchange(turn: int):
        def meet(key: tuple, table: pa.Table) -> pa.Table:
            run = merge(_read(table))
            schema = piece_schema(run.id.type)
            return pa.Table.from_batches(list(_pieces(deal(run, key[0].as_py(), turn, rounds), schema)), schema)

        return meet

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        run = merge(_read(table))
        run = run.take(np.flatnonzero(run.n > 1))
        raw = run.words.astype(">u8").tobytes()
        return pa.table({"sha": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), "group_size": run.n, "keep_id": run.id, "keep_row": run.row})

    parts = rows.select("id", "chars", "row", "sha").mapInArrow(runs, travelling)
    for turn in range(1, rounds):
        parts = parts.groupBy("node").applyInArrow(exchange(turn), travelling)
    return parts.groupBy("node").applyInArrow(finish, f"sha binary, group_size bigint, keep_id {element}, keep_row bigint")


def bare(text: Column) -> Column:
    """The text without white space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(bare(text).cast("binary"), 256))


def exact_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha (binary)."""
    chars = F.coalesce(F.length(F.col(text)), F.lit(0)).cast("bigint")
    rows = stored(documents.select(F.col(doc_id).alias("id"), chars.alias("chars"), F.monotonically_increasing_id().alias("row"), digest(F.col(text)).alias("sha")))
    groups = stored(tree_merge(rows, node_rows))
    joined = rows.join(groups, "sha", "left")  # Spark splits the rows of a hot text
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "sha",
    )


def distinct_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in id, text and length one."""
    id_, sha, own = free_name(documents, "_id", "_sha", "_own")
    kept = exact_copies(documents, text, doc_id).where("kept").select(F.col("doc_id").alias(id_), F.col("sha").alias(sha))
    found = documents.withColumn(own, digest(F.col(text))).join(kept, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)))
    # an id may stand beside the same text in several lengths
    best = found.groupBy(id_, sha).agg(F.max_by(F.struct(*[found[x] for x in documents.columns]), F.coalesce(F.length(F.col(text)), F.lit(0))).alias("best"))
    return best.select("best.*")


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
w as (select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
        first_value(doc_id) over best as keep_id, row_number() over best as place
      from d window best as (partition by text_sha256 order by chars desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from w
"""


@query("op11_exact_tree_merge", SQL)
def op11_exact_tree_merge(t):
    found = exact_copies(t.documents.select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
