"""Source divergence: how the term frequencies of the sources of a language differ.

Terms are counted per (lang, source) inside every task before anything is shuffled. A language keeps
the terms that enough of its documents hold. Pairs of sources are compared through joint tables: with
an indicator column for every (source, count level), the product of the transposed indicator matrix
with itself holds, for each two sources, how many terms have level i in one and level j in the other.
The distance of the pair is then priced from the table alone, because a share depends on the level
only. Terms are sorted by their total, so that a block of terms has few levels; the product of a block
is taken over the columns that occur in it, tile by tile of sources, in float32 whose sums stay exact.

Shares are whole numbers: p = 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V)), with N the counts
of a group over all V kept terms of its language.

Cases: null text, lang and source are ''; a source without terms is a group with all counts 0; a
language without kept terms has pairs of value 0 and no terms; equal rows count each; empty tables give
no rows; texts of any length are used whole, ids and other columns are not read. Bytes that are not
UTF-8 belong to terms as they are and are replaced by U+FFFD in the result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.llm.common import bounded_batches, stored
from keelson.registry import query

c = F.col

LEAST_DOCS, SMOOTH, UNIT, RANKS = 30, 5, 1_000_000_000, 50
HELD = 150_000  # terms that a task holds before it hands them on
SENT = 8192  # terms of a batch that it hands on
DOCS = -1  # beside the places of sources: the documents of a term
BLOCK_TERMS = 4096  # terms of a block; float32 counts them exactly
BLOCK_COLUMNS = 1024  # indicator columns of one tile of sources
TILE = 64  # sources of a tile
CELLS = 4_000_000  # sums that a task holds

#: One byte each: letters of ASCII in lower case and all bytes beyond ASCII stay, the rest separates.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def counted(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, docs, sources and ns (occurrences in each source), as far as a task sees them; a null
    term lists the sources of the language."""
    bounded_batches(documents.sparkSession)
    bare = [F.coalesce(c(x).cast("string"), F.lit("")) for x in (lang, source)]
    fed = documents.select(*[x.alias(n) for x, n in zip(bare, ("lang", "source"), strict=True)], F.coalesce(c(text), F.lit("")).cast("binary").alias("text"))
    names = ["lang", "term", "docs", "sources", "ns"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def batches_of(held: dict) -> Iterator[pa.RecordBatch]:
        for of_lang, (sources, own) in held.items():
            every = list(sources)
            entries = chain([(None, {DOCS: 0} | dict.fromkeys(range(len(every)), 0))], own.items())
            while part := list(islice(entries, SENT)):
                found = [[(s, n) for s, n in e.items() if s != DOCS] for _, e in part]
                columns = [[of_lang] * len(part), [t for t, _ in part], [e[DOCS] for _, e in part], [[every[s] for s, _ in x] for x in found], [[n for _, n in x] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for of_lang, of_source, body in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                sources, own = held.setdefault(of_lang, ({}, {}))
                s = sources.setdefault(of_source, len(sources))
                for t, n in Counter(terms(body)).items():
                    e = own.get(t)
                    if e is None:
                        own[t] = {DOCS: 1, s: n}
                    else:
                        e[DOCS] += 1
                        e[s] = e.get(s, 0) + n
            if sum(len(own) for _, own in held.values()) > HELD:
                yield from batches_of(held)
                held = {}
        yield from batches_of(held)

    return fed.mapInArrow(run, "lang string, term binary, docs bigint, sources array<string>, ns array<bigint>")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)) in three steps of long division, which stay
    below 2**63 for totals up to 9 * 10**15."""
    whole = total + SMOOTH * kept
    rest = count + SMOOTH
    out = F.call_function("div", rest, whole)
    for _ in range(3):
        rest = (rest % whole) * 1000
        out = out * 1000 + F.call_function("div", rest, whole)
    return out + 1


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same on arrays."""
    rest = count + SMOOTH
    out = rest // whole
    for _ in range(3):
        rest = rest % whole * 1000
        out = out * 1000 + rest // whole
    return out + 1


def joint_tables(levels: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Joint tables of two sets of columns of ``levels`` (terms x sources, counts).

    Yields (rows, left columns, right columns, table): columns are (source, level) pairs, and the table
    counts the terms of these rows that have both. Rows are taken together as long as their indicator
    columns stay below BLOCK_COLUMNS, a single row always fits."""
    at, most = 0, max(1, BLOCK_COLUMNS // max(1, len(left), len(right)))
    while at < len(levels):
        # a source has at most as many levels as the block has terms
        size = min(most, len(levels) - at)
        while at + 2 * size <= len(levels) and size < BLOCK_TERMS and max(len(_columns(levels[at : at + 2 * size, x])) for x in (left, right)) <= BLOCK_COLUMNS:
            size *= 2
        part = levels[at : at + size]
        (a, one_a), (b, one_b) = (_indicator(part[:, x]) for x in (left, right))
        yield slice(at, at + size), a, b, one_a.T @ one_b
        at += size


def _columns(part: np.ndarray) -> np.ndarray:
    """Distinct (place of the source, level) of a block."""
    place = np.broadcast_to(np.arange(part.shape[1]), part.shape)
    return np.unique(np.stack([place.ravel(), part.ravel()], axis=1), axis=0)


def _indicator(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (source, level) columns of a block and its indicator matrix."""
    pairs = np.stack([np.broadcast_to(np.arange(part.shape[1]), part.shape).ravel(), part.ravel()], axis=1)
    columns, of = np.unique(pairs, axis=0, return_inverse=True)
    one = np.zeros((part.shape[0], len(columns)), np.float32)
    one[np.repeat(np.arange(part.shape[0]), part.shape[1]), of.ravel()] = 1
    return columns, one


def priced(levels: np.ndarray, whole: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of abs(p - q) over the terms for each pair of the columns ``left`` and ``right``, from the joint tables."""
    out = np.zeros((len(left), len(right)), np.int64)
    for _, a, b, table in joint_tables(levels, left, right):
        i, j = np.nonzero(table)
        p = shares(a[i, 1], whole[left][a[i, 0]])
        q = shares(b[j, 1], whole[right][b[j, 0]])
        # shares are at most 10**9 + 1 and add up to little more, so a long holds the sum
        np.add.at(out, (a[i, 0], b[j, 0]), table[i, j].astype(np.int64) * np.abs(p - q))
    return out


def pair_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for each two sources of a language (places in ``groups``, a < b).

    ``kept``: lang, total and counts (array of (place, n)) of every kept term. ``groups``: lang, place,
    whole (N + SMOOTH * V). The list of groups goes to every task: the result has a row for each two
    groups of a language, so it is far smaller than the result."""
    spark = kept.sparkSession
    sizes: dict[str, list] = {}
    for r in groups.select("lang", "place", "whole").toLocalIterator():
        sizes.setdefault(r["lang"], []).append((r["place"], r["whole"]))
    shared = spark.sparkContext.broadcast({lang: np.array([w for _, w in sorted(x)], np.int64) for lang, x in sizes.items()})

    def rows_of(sums: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for (lang, left, right), value in sums.items():
            i, j = (x.ravel() for x in np.indices(value.shape))
            a, b = i + left, j + right
            use = a < b
            for column, part in zip(columns, ([lang] * int(use.sum()), a[use], b[use], value.ravel()[use]), strict=True):
                column.extend(part)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(np.array(x, np.int64)) for x in columns[1:]]], names=["lang", "a", "b", "value"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
        """Runs of rows of one language."""
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                yield langs[low], batch.column(1).slice(low, high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        held = 0
        for lang, counts in blocks(batches):
            whole = shared.value[lang]
            for low in range(0, len(counts), max(1, min(BLOCK_TERMS, CELLS // len(whole)))):
                part = counts.slice(low, max(1, min(BLOCK_TERMS, CELLS // len(whole))))
                entries = part.flatten()
                levels = np.zeros((len(part), len(whole)), np.int64)
                of = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                levels[of, entries.field("place").to_numpy(zero_copy_only=False)] = entries.field("n").to_numpy(zero_copy_only=False)
                tiles = [np.arange(x, min(len(whole), x + TILE)) for x in range(0, len(whole), TILE)]
                for i, left in enumerate(tiles):
                    for right in tiles[i:]:
                        key, value = (lang, int(left[0]), int(right[0])), priced(levels, whole, left, right)
                        if key in sums:
                            sums[key] += value
                        else:
                            sums[key] = value
                            held += value.size
                        if held > CELLS:
                            yield rows_of(sums)
                            sums, held = {}, 0
        if sums:
            yield rows_of(sums)

    # terms of like totals stand together; range partitions hold rows, not languages
    sorted_ = kept.select("lang", "counts", "total", "term").repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term")
    parts = sorted_.select("lang", "counts").mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    # one row a term from every task: what few documents hold goes before sources are told apart
    docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    common = counted(documents, text, lang, source).withColumn("docs", docs).where(c("term").isNull() | (c("docs") >= least))
    each_source = common.select("lang", "term", F.inline(F.arrays_zip(c("sources").alias("source"), c("ns").alias("n"))))
    sums = stored(each_source.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")))
    # all sources of a language have a place, those without terms too
    named = sums.where("term is null").select("lang", "source")
    numbered = stored(named.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1))
    placed = sums.where("term is not null").join(numbered, ["lang", "source"])
    kept = stored(
        placed.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("counts"))  # one entry a source at most
    )
    each = kept.select("lang", "term", "total", F.explode("counts").alias("x")).select("lang", "term", "total", "x.*")
    of_group = each.groupBy("lang", "place").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    groups = stored(
        numbered.join(of_group, ["lang", "place"], "left").join(of_lang, "lang", "left")
        .select("lang", "source", "place", *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("size", "kept", "all")])
        .withColumn("whole", c("size") + SMOOTH * c("kept"))
    )
    found = pair_distances(kept, groups)
    one, two = (groups.select("lang", c("place").alias(p), c("source").alias(s)) for p, s in (("a", "source_a"), ("b", "source_b")))
    # every two sources of a language are in the result, whether or not terms tell them apart
    pairs = one.join(two, "lang").where("a < b").join(found, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    both = F.array(F.struct(c("source_a").alias("source"), c("source_b").alias("item")), F.struct(c("source_b").alias("source"), c("source_a").alias("item")))
    pairs = stored(pairs.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), c("x.item").alias("item"), "value"))
    own = each.join(groups, ["lang", "place"])
    own = own.select("lang", "source", "term", share(c("n"), c("size"), c("kept")).alias("p"), share(c("total"), c("all"), c("kept")).alias("q")).where("p > q")
    item = c("term").cast("string")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(c("value").desc(), c("order")))
    ranked_pairs = pairs.withColumn("order", c("item").cast("binary")).withColumn("rank", rank)
    ranked_terms = own.select("lang", "source", F.lit("term").alias("part"), item.alias("item"), (c("p") - c("q")).alias("value"), c("term").alias("order")).withColumn("rank", rank).where(c("rank") <= ranks)
    return ranked_pairs.unionByName(ranked_terms).drop("order")


SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as total from words group by 1, 2 having count(distinct id) >= 30),
groups as (select distinct lang, source from d),
counts as (select lang, source, term, count(*) as n from words group by 1, 2, 3),
cells as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n from groups g join kept k using (lang) left join counts c using (lang, source, term)),
sizes as (select lang, source, sum(n) as size, count(*) as v from cells group by 1, 2),
langs as (select lang, sum(total) as size, count(*) as v from kept group by 1),
p as (select lang, source, term, n, (1 + (1000000000 * (n + 5)) // (size + 5 * v)::hugeint)::bigint as p from cells join sizes using (lang, source)),
q as (select lang, term, (1 + (1000000000 * (total::hugeint + 5)) // (size + 5 * v)::hugeint)::bigint as p from kept join langs using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by 1, 2, 3),
every_pair as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
found as (select lang, source, 'pair' as part, item, value from every_pair
    union all select lang, source, 'term', term, p.p - q.p from p join q using (lang, term) where n > 0 and p.p > q.p),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


@query("op13_source_divergence", SQL)
def op13_source_divergence(t):
    return divergence(t.documents.select("text", "lang", "source"))
