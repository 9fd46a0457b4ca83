"""Benchmark decontamination by Wu-Manber search over words.

A text is the sequence of its normalised words; the test strings are the ten-word windows of the
items. Blocks of two words index a shift table; most places of a text are skipped, a place of shift
zero looks up the bucket of the window's last block, and a direct comparison confirms it.

Cases: a null or wordless text has no words and is clean; items without words or text give no test
string; items without an id are searched for, but not named; equal items each count; equal rows are
searched one by one; bytes that are not UTF-8 belong to words as they are."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from keelson.llm.common import bounded_batches, free_name, map_columns, stored
from keelson.registry import query

WINDOW = 10
BLOCK_CHARS = 2_000_000  # characters of items searched for in one pass: bounds what is collected and broadcast to some 100 MB

#: A-Z becomes a-z; bytes that belong to no word become spaces.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and all bytes beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


@dataclass
class Search:
    """Wu-Manber tables for test strings of one length (in words)."""

    length: int
    block: int
    shift: dict[int, int] = field(default_factory=dict)
    buckets: dict[int, dict[tuple, list[str]]] = field(default_factory=dict)

    def add(self, string: tuple[int, ...], item: str, base: int) -> None:
        last = self.length - self.block
        for at in range(last + 1):
            key = self.key(string, at, base)
            self.shift[key] = min(self.shift.get(key, last + 1), last - at)
        items = self.buckets.setdefault(self.key(string, last, base), {}).setdefault(string, [])
        if item not in items:
            items.append(item)

    def key(self, string, at: int, base: int) -> int:
        return string[at] * base + string[at + 1] if self.block == 2 else string[at]

    def find(self, ids: list[int], base: int) -> list[tuple[int, list[str]]]:
        """(first word, items) of every occurrence. Id 0 is a word of no test string."""
        out, m, n = [], self.length, len(ids)
        shift, buckets, far = self.shift.get, self.buckets, m - self.block + 1
        at, pair = m - 1, self.block == 2
        while at < n:
            key = ids[at - 1] * base + ids[at] if pair else ids[at]
            step = shift(key, far)
            if step:
                at += step
                continue
            if (hits := buckets[key].get(tuple(ids[at - m + 1 : at + 1]))) is not None:
                out.append((at - m + 1, hits))
            at += 1
        return out


@dataclass
class Tables:
    """Everything a task needs for one block of items."""

    vocabulary: dict[bytes, int]
    searches: list[Search]


def build_tables(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Tables:
    """Shift tables and buckets of all windows of (item id, text)."""
    vocabulary: dict[bytes, int] = {}
    strings: list[tuple[tuple[int, ...], str]] = []
    for item, text in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        if ids:
            width = min(window, len(ids))
            strings += [(ids[i : i + width], item) for i in range(len(ids) - width + 1)]
    base, searches = len(vocabulary) + 1, {}
    for string, item in strings:
        n = len(string)
        searches.setdefault(n, Search(n, min(2, n))).add(string, item, base)
    return Tables(vocabulary, list(searches.values()))


def scan(text: bytes | None, tables: Tables) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged word spans [from, to) inside occurrences, and ids of the items found."""
    words = words_of(text)
    find = tables.vocabulary.get
    ids = [find(w, 0) for w in words]
    spans, items = [], set()
    if any(ids):
        for search in tables.searches:
            for at, found in search.find(ids, len(tables.vocabulary) + 1):
                spans.append((at, at + search.length))
                items.update(x for x in found if x is not None)
    return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


SPANS = ArrayType(StructType([StructField("from", IntegerType()), StructField("to", IntegerType())]))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, hit_spans (disjoint word spans inside occurrences), items (ids found) and contaminated.

    The items are searched for in blocks of about ``block_chars`` characters, one pass over the
    documents each, so that what is broadcast is bounded for a benchmark of any size; the passes
    add up their findings in the same columns."""
    spark = documents.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    spans, found = free_name(documents, "hit_spans", "items")
    out = documents
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number) if blocks > 1 else items
        # at most about block_chars characters reach the driver at a time
        rows = [(r["item"], bytes(r["text"])) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(build_tables(rows, window))
        earlier = number > 0

        def compute(batch: pa.RecordBatch, shared=shared, earlier=earlier) -> list:
            words, marks, ids = [], [], []
            for i, body in enumerate(batch.column(0).to_pylist()):
                n, s, x = scan(body, shared.value)
                if earlier:
                    s = merged([*s, *((d["from"], d["to"]) for d in batch.column(1)[i].as_py())])
                    x = sorted({*x, *batch.column(2)[i].as_py()})
                words.append(n)
                marks.append([{"from": a, "to": b} for a, b in s])
                ids.append(x)
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            return [pa.array(words, pa.int64()), pa.array(marks, span), pa.array(ids, pa.list_(pa.string())), pa.array([bool(s) for s in marks])]

        added = [StructField("n_words", LongType()), StructField(spans, SPANS), StructField(found, ArrayType(StringType())), StructField("contaminated", BooleanType())]
        inputs = [F.col(text).cast("binary"), *([F.col(spans), F.col(found)] if earlier else [])]
        out = map_columns(out, inputs, added, compute, out.columns)
        if number + 1 < blocks:
            out = stored(out)
    return out


def hit_words(spans: str = "hit_spans"):
    """Number of words inside occurrences."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])


OP7_SQL = r"""
with low as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
items as (select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where text is not null),
tests as (select distinct item, least(10, len(ws)) k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') s from items, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) where len(ws) > 0),
places as (select id, k, i, array_to_string(ws[i:i + k - 1], ' ') s from low, (select distinct k from tests), unnest(range(1, len(ws) - k + 2)) u(i)),
hits as (select id, i, tests.k, item from places join tests on places.k = tests.k and places.s = tests.s),
marked as (select id, count(distinct w) n from hits, unnest(range(i, i + k)) u(w) group by id),
named as (select id, string_agg(item, ',' order by item) names, count(item) n from (select distinct id, item from hits) group by id)
select low.id as doc_id, len(ws)::bigint as n_words, coalesce(marked.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, marked.n is not null as contaminated
from low left join marked on marked.id = low.id left join named on named.id = low.id
"""


@query("op7_wu_manber", OP7_SQL)
def op7_wu_manber(t):
    found = contamination(t.documents.select("doc_id", "text"), t.benchmark)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
