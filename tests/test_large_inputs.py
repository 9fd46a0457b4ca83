"""Steps whose cost must grow no faster than their input: same results as plain loops, and a plan without the costly step."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson import plans
from keelson.functions import text as tx
from keelson.operators import curation, dense, lexical
from keelson.registry import callables
from keelson.streaming import ordered


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def hashed_loop(tokens, han):
    sums = Counter()
    for w in tokens:
        size = 2 if w in han else 3
        for f in [w, *(w[i : i + size] for i in range(len(w) - size + 1))]:
            h = 2166136261
            for x in f:
                h = ((h ^ ord(x)) * 16777619) & 0xFFFFFFFF
            sums[h % 256] += 1 if h % 2 == 0 else -1
    return {k: v for k, v in sums.items() if v}


def test_texts_are_hashed_in_their_row(spark):
    words = ["ab", "Straße", "x", "x", "漢字文", "漢", "a.b-c#", "w" * 700, "\U00020000\U00020001", "é1"]
    rows = [(1, " ".join(words)), (2, None), (3, " \n! "), (4, "twice"), (4, "Twice more"), (5, "one")]
    vectors = dense.hashed_vectors(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    got = {r["id"]: {i: v for i, v in enumerate(r["embedding"]) if v} for r in vectors.collect()}
    low = [w.lower() for w in words]
    want = {1: hashed_loop(low, {"漢字文", "漢", "\U00020000\U00020001"}), 4: hashed_loop(["twice", "twice", "more"], ()), 5: hashed_loop(["one"], ())}
    assert got == want
    dims = dense.hashed_dimensions(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    assert {(r["id"], r["bucket"], r["v"]) for r in dims} == {(i, b, v) for i, x in want.items() for b, v in x.items()}
    alone = dense.hashed_vectors(spark.range(9).select("id", F.col("id").cast("string").alias("text")), "id", "text")
    assert "Aggregate" not in plan_of(alone) and "Generate" not in plan_of(alone)


def test_bm25_reads_the_texts_once(spark):
    records = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None), (4, "")], "id bigint, text string")
    queries = spark.createDataFrame([(7, "red fox")], "query_id bigint, query string")
    hits = lexical.bm25_hits(lexical.query_terms(queries), records)
    weights = lexical.bm25_weights(lexical.query_terms(queries), hits)
    assert [r["avgdl"] for r in weights.collect()] == [pytest.approx(5 / 3)] * 2
    assert {r["term"] for r in weights.collect()} == {"red", "fox"}
    scored = lexical.bm25_scores(queries, records)
    assert {r["id"] for r in scored.collect()} == {1, 2}
    scored.collect()
    tree = scored._jdf.queryExecution().executedPlan().toString()
    assert tree.split("Initial Plan")[0].count("ReusedExchange") >= 2


class Held:
    """A state that counts its calls; a list state holds ``value`` as a list."""

    def __init__(self, calls, value=None):
        self.calls, self.value = calls, value

    def __getattr__(self, name):
        raise AssertionError(f"a call for each change: {name}")

    def get(self):
        self.calls.append("get")
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    put = update

    def appendList(self, rows):
        self.calls.append("append")
        self.value += rows

    def clear(self):
        self.calls.append("clear")
        self.value = []


def test_waiting_changes_are_written_together():
    import pandas as pd

    calls, timers = [], []

    class Handle:
        getListState = staticmethod(lambda *_: Held(calls, []))
        getValueState = staticmethod(lambda *_: Held(calls))
        registerTimer = staticmethod(timers.append)

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)

    work = ordered.Coordination()
    work.init(Handle())
    rows = [(r, r * 1000, r - 1, "note", 0, 0, None, None, 0) for r in range(1, 400) if r != 30]
    batches = [pd.DataFrame(x, columns=["revision", *ordered.names_of(work.CHANGE)]) for x in (rows[200:], rows[:200], rows[:40])]
    out = [r for x in batches for part in work.handleInputRows((1,), iter([x]), None) for r in part.itertuples(index=False)]
    assert [r[1] for r in out if r[3] != "late"] == list(range(1, 30)) and len(work.early.value) == 369
    out += [r for part in work.handleExpiredTimer((1,), Times(), None) for r in part.itertuples(index=False)]
    assert sorted(r[1] for r in out if r[3] != "late") == [r[0] for r in rows] and work.early.value == []
    assert [r[1] for r in out if r[2]] == [31] and len(calls) <= 16 and timers


def test_equal_intervals_are_swept_as_one(spark, monkeypatch):
    """Repeated intervals cost a weight; a null key, as in SQL, meets none."""
    kinds = [("a", 0, 5, "x", None), ("a", 3, 9, None, 1), ("a", 5, 9, "y", 1), ("a", 4, 4, "x", 1), (None, 0, 9, "x", 1)]
    rows = [(i, *kinds[i % 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, key string, start bigint, end bigint, project string, tenant bigint")
    sorted_rows, running = [], curation.running_sum
    monkeypatch.setattr(curation, "running_sum", lambda points, *args: sorted_rows.append(points.count()) or running(points, *args))
    got = {(r["id"] % 5, r["overlaps"]) for r in curation.scope_overlap_counts(df, "key", ["project", "tenant"], lambda t: F.floor(t / 4)).collect()}
    assert got == {(0, 399), (1, 599), (2, 399), (3, 0), (4, 0)}
    assert sorted_rows[0] < 60


def test_anchors_are_formed_once(spark):
    plans.load()
    plan = plan_of(callables()["f12_surface_anchors"](spark, "/root/testdata/sf0.001"))
    assert plan.count("array_distinct(") == 1
    text = "see v1.2.3, (ERR_9) AB ABC 'two words' plain Word parseHttp HttpUrl aB c " + "x" * 40_000 + " éÉÉ ٣"
    got = spark.createDataFrame([(text,)], "t string").select(tx.surface_anchors(F.col("t"), unicode=False)).first()[0]
    assert got == ["two words", "v1.2.3", "err_9", "abc", "httpurl"]


def test_equal_scores_do_not_pile_up_in_a_cell():
    """Rows that all tie are cut to ``k`` a query, smallest ids first, as they are scored."""
    import tracemalloc

    import numpy as np

    ids = np.random.default_rng(1).permutation(5_000)
    rows, asked = np.ones((5_000, 4)), dense._unit_rows(np.ones((400, 4)))
    tracemalloc.start()
    q, i, s = dense._score_block(ids, rows, np.arange(400), asked, 3, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(q, i)) == [(n, x) for n in range(400) for x in range(3)] and set(s) == {1.0}
    assert peak < 3 * 8 * dense.CELLS


def test_a_vector_without_a_score_takes_no_other_row_along(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [None, 1.0])], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [nan, 0.0]), (9, None)], "query_id bigint, embedding array<double>")
    got = dense.vector_top_k(rows, asked, 2).collect()
    assert sorted((r["query_id"], r["id"], r["cosine"], r["rank"]) for r in got) == [(7, 1, 1.0, 1), (7, 3, 0.707107, 2)]


def test_the_shortlist_of_a_scorer_is_formed_once(spark, monkeypatch):
    """Training and scoring read kept rows; the vectors are not met again for each of them."""
    from keelson.plans import graph

    plans.load()
    kept, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(1) or cut(df))
    assert "CoGroups" not in plan_of(callables()["g15_relevance_scorer"](spark, "/root/testdata/sf0.001")) and len(kept) == 1
