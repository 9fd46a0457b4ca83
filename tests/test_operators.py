"""Hand-made fixtures and brute-force checks for what SQL does not express."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson import plugins
from keelson.functions import text as tx, time as tm, vectors as vx, vocabulary as vb, windows as wx
from keelson.operators import belief, budget, curation, dense, learning, lexical, similarity, topology
from keelson.sources import loaders, sinks


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(fn(F.col("v"))).collect()]


def test_nfkc_only_touches_unstable_text(spark):
    got = column(spark, ["plain", "ﬁne", "Ｆｕｌｌ", "é", "é"], tx.nfkc)
    assert got == ["plain", "fine", "Full", "é", "é"]


def test_statement_and_identity_forms(spark):
    assert column(spark, ["  Hello, WORLD!! \n"], tx.statement_form) == ["hello world"]
    assert column(spark, ["New-York  City"], tx.identity_form) == ["newyorkcity"]


def test_han_terms_add_pairs(spark):
    got = column(spark, ["记忆检索系统 test the"], tx.search_terms)[0]
    assert "test" in got and "the" not in got and "记忆" in got and "系统" in got


def test_fnv_hashes(spark):
    words = ["", "a", "foobar", "ünï"]

    def fnv(word, offset, prime, mask):
        h = offset
        for ch in word:
            h = ((h ^ ord(ch)) * prime) & mask
        return h

    assert column(spark, words, vx.fnv32) == [fnv(w, 2166136261, 16777619, 2**32 - 1) for w in words]
    expected = [fnv(w, 14695981039346656037, 1099511628211, 2**64 - 1) for w in words]
    assert [v % 2**64 for v in column(spark, words, vx.fnv64)] == expected


def test_event_time_phrases(spark):
    ref = F.expr("timestamp_ntz'2026-11-18 15:30:00'")
    phrases = ["2026-02-31", "11月6日", "12月6日", "上周三", "三天前", "last month", "2026-11-06T10:20:30+08:00", "noise"]
    got = column(spark, phrases, lambda v: tm.parse_event_time(v, ref)["start"].cast("string"))
    assert got == [None, "2026-11-06 00:00:00", "2025-12-06 00:00:00", "2026-11-11 00:00:00", "2026-11-15 00:00:00", "2026-10-01 00:00:00", "2026-11-06 02:20:30", None]


def test_event_window_needs_intent_for_absolute_dates(spark):
    rows = spark.createDataFrame([("3月10号之前做了什么",), ("把 2026年11月6日 的会议记下来",)], "q string").withColumn("r", F.expr("timestamp_ntz'2026-11-18 00:00:00'"))
    got = [(r.window_from, r.window_to is not None) for r in tm.with_event_window(rows, "q", "r").collect()]
    assert got == [(None, True), (None, False)]


@pytest.mark.parametrize(
    "prompt,mode",
    [
        ("do you remember the plan", "retrieve"), ("what should i cook", "retrieve"), ("please suggest a book", "cue"), ("你记得吗", "retrieve"),
        ("你记得。别的事吗", "none"), ("where is my key", "retrieve"), ("tell where my key", "none"), ("planner notes", "none"), ("what did anna say", "retrieve"), ("what did 5 say", "none"),
        ("我们之间很久很久很久很久以来一直都没有用过", "none"), ("我用过", "retrieve"),
    ],
)
def test_recall_vocabulary(spark, prompt, mode):
    assert column(spark, [prompt], vb.recall_mode) == [mode]


def test_query_windows_cover_text_once(spark):
    text = ". ".join(f"sentence number {i} of the long text" for i in range(300))
    parts = column(spark, [text], wx.query_windows)[0]
    assert "".join(parts) == text and len(parts) == math.ceil(len(text) / 2000)
    long = "x" * 45_000
    sampled = column(spark, [long], wx.query_windows)[0]
    assert len(sampled) == 10 and all(len(p) == 2000 for p in sampled)


def test_fibonacci_targets():
    assert budget.fibonacci_targets(1) == [1]
    assert budget.fibonacci_targets(20) == [1, 2, 3, 5, 8, 13, 20]


def test_pack_matches_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        items = pd.DataFrame({"query_id": 1, "id": range(8), "key": [str(i) for i in range(8)], "chars": [rng.randint(20, 700) for _ in range(8)], "utility": [round(rng.random(), 3) for _ in range(8)], "position": range(8)})
        picked, used = budget._pack(items, 3, 1000)
        cost = lambda rows: sum(math.ceil((r.chars + 2) / 4) for r in rows)
        best = 0.0
        for size in range(1, 4):
            for rows in itertools.combinations(list(items.itertuples()), size):
                if cost(rows) <= (1000 + 2) // 4:
                    best = max(best, sum(r.utility for r in rows))
        assert abs(picked["utility"].sum() - best) < 1e-4 and used <= 1002


def test_staged_recall_skips_and_retries(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1400), (1, 2, 2, 400), (1, 3, 3, 90)], "query_id int, id bigint, position int, chars int")
    got = budget.staged_recall(rows, available=1900).collect()[0]
    assert sorted(got.ids) == [1, 2, 3] and got.used == 1890
    assert budget.recall_stages(1900) == [(1500, 20), (1900, 20)]


def test_weighted_depths_are_optimal(spark):
    weights = [5.0, 9.0, 12.0, 13.0, 16.0, 45.0]
    rows = spark.createDataFrame([("n", i, w) for i, w in enumerate(weights)], "block string, id bigint, weight double")
    depth = {r.id: r.depth for r in budget.weighted_depths(rows).collect()}
    assert sum(weights[i] * d for i, d in depth.items()) == 224.0


def test_posterior_and_decision(spark):
    votes = spark.createDataFrame([(1, 0, "supported", 1.0)] * 10 + [(2, 0, "contradicted", 1.0)] * 4, "id int, claim_index int, outcome string, weight double")
    got = {r.id: r.decision for r in belief.decisions(belief.posteriors(votes, F.lit(0.5))).collect()}
    assert got == {1: "promote", 2: "retract"}


def test_upsert_is_idempotent(spark):
    existing = spark.createDataFrame([(1, 10, 1)], "key int, payload int, revision int")
    batch = spark.createDataFrame([(1, 7, "h", 1, 11), (1, 7, "h", 2, 12), (2, 7, "h", 3, 20)], "key int, operation_id int, request_hash string, slot int, payload int")
    none = spark.createDataFrame([], "operation_id int, request_hash string")
    merged, _ = sinks.plan_upsert(existing, batch, none)
    first = sorted(map(tuple, merged.collect()))
    assert first == [(1, 12, 2), (2, 20, 1)]
    again, conflicts = sinks.plan_upsert(merged, batch, spark.createDataFrame([(7, "h")], "operation_id int, request_hash string"))
    assert sorted(map(tuple, again.collect())) == first and conflicts.count() == 0
    _, conflicts = sinks.plan_upsert(merged, batch, spark.createDataFrame([(7, "other")], "operation_id int, request_hash string"))
    assert conflicts.count() == 3


def test_vector_ways_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, embedding array<float>")
    queries = rows.where("id < 12").select(F.col("id").alias("query_id"), "embedding")
    a = sorted(map(tuple, dense.vector_top_k(rows, queries, 4).select("query_id", "id", "rank").collect()))
    b = sorted(map(tuple, dense.vector_top_k(rows, queries, 4, limit=5).select("query_id", "id", "rank").collect()))
    f = m.astype("float32").astype("float64")
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    want = []
    for q in range(12):
        s = np.round(u @ u[q], 6)
        order = sorted((x for x in range(200) if s[x] > 0), key=lambda x: (-s[x], x))[:4]
        want += [(q, x, r + 1) for r, x in enumerate(order)]
    assert a == b == sorted(want)


def test_similar_records_with_a_hot_group_of_copies(spark):
    rows = [(i, "b", "the quick brown fox jumps over dogs") for i in range(40)] + [(100, "b", "the quick brown fox jumps over cats"), (101, "b", "nothing alike here at all")]
    got = similarity.similar_records(spark.createDataFrame(rows, "id bigint, node string, statement string"), ["node"], 0.5, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.rank, r.other, r.similarity))
    assert sorted(by[0]) == [(k, k, 1.0) for k in range(1, 9)]
    assert sorted(by[100])[0] == (1, 0, 0.75) and len(by[100]) == 8 and 101 not in by


def test_cycles_and_components(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (10, 12), (11, 10), (12, 11), (20, 10)], "id int, predecessor int")
    assert sorted(r.id for r in curation.cyclic_links(links).collect()) == [10, 11, 12, 20]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a int, b int")
    got = {r.node: r.component for r in topology.connected_components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}


def test_pair_examples_are_capped(spark):
    rows = spark.createDataFrame([(1, i, int(i < 5)) for i in range(50)], "query_id int, id int, label int")
    pairs = learning.pair_examples(rows, "label", cap=4).collect()
    assert len(pairs) == 20 and len({(p.positive, p.negative) for p in pairs}) == 20


def test_ranker_degrades_whole_page(spark):
    page = spark.createDataFrame([(1, 1, "q", "a", 1), (1, 2, "q", "bad", 2), (2, 3, "q", "a", 1)], "query_id int, id int, query string, text string, rank int")
    out = plugins.rank_with(page, lambda q, t: t.map({"a": 0.5, "bad": 3.0}))
    assert sorted((r.id, r.utility, r.degraded) for r in out.collect()) == [(1, 1.0, True), (2, 0.5, True), (3, 0.5, False)]
    with pytest.raises(ValueError):
        plugins.guard_model({"embedder": "a"}, "b", "x")


def test_loaders(spark, tmp_path):
    case = [{"id": "q1", "benchmark": "b", "category": "c", "question": "?", "reference": "r", "evidenceIds": ["1"],
             "sessions": [{"id": "s1", "date": "d", "turns": [{"role": "AI", "speaker": "x", "content": "hi", "sourceId": "1"}, {"role": "human", "content": "yo", "sourceId": "2"}]}]}]
    (tmp_path / "cases.json").write_text(json.dumps(case))
    turns = loaders.case_turns(loaders.read_cases(spark, str(tmp_path / "cases.json"))).orderBy("ordinal").collect()
    assert [(t.role, t.content, t.ordinal) for t in turns] == [("assistant", "hi", 0), ("user", "yo", 1)]
    log = tmp_path / "events.jsonl"
    log.write_text('{"version":2,"graphId":"g","type":"view"}\nnot json\n{"version":9,"graphId":"g"}\n')
    (tmp_path / "events.jsonl.1").write_text('{"version":1,"graphId":"h","type":"use"}\n')
    good, bad = loaders.read_event_log(spark, str(log))
    assert sorted(r.graphId for r in good.collect()) == ["g", "h"] and bad.count() == 2
    locomo = [{"sample_id": "m", "qa": [{"question": "?", "answer": "a", "category": 1, "evidence": ["D1:1"]}],
               "conversation": {"session_1": json.dumps([{"speaker": "A", "dia_id": "D1:1", "text": "t"}]), "session_1_date_time": "1 May"}}]
    (tmp_path / "locomo.json").write_text(json.dumps(locomo))
    qs, ts = loaders.read_locomo(spark, str(tmp_path / "locomo.json"))
    assert qs.count() == 1 and [(r.session, r.date, r.source_id) for r in ts.collect()] == [("session_1", "1 May", "D1:1")]
    csv, ctx = tmp_path / "q.csv", tmp_path / "ctx.jsonl"
    csv.write_text('question_id,user_question\n1,"a ""quoted"", one"\n')
    ctx.write_text(json.dumps({"c1": [{"role": "system", "content": "s"}, {"role": "bot", "content": "b"}]}) + "\n")
    qs, ts = loaders.read_personamem(spark, str(csv), str(ctx))
    assert qs.collect()[0].user_question == 'a "quoted", one' and [r.role for r in ts.orderBy("ordinal").collect()] == ["system", "assistant"]


def test_disclosure_fold_against_loop(spark, tmp_path):
    from keelson.streaming import streams as st

    rng = random.Random(1)
    rows = [(i % 3, i, float(i), rng.randint(0, 4), rng.choice("ab"), rng.randint(0, 2)) for i in range(300)]
    schema = "session bigint, event_id bigint, time double, memory int, content string, depth int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.folded for r in st.run_to_table(st.disclosure_fold(stream, turns=6), str(tmp_path / "run")).collect()}
    state, turn, want = {}, {}, {}
    for s, e, _, m, content, depth in rows:
        turn[s] = turn.get(s, 0) + 1
        old = state.get((s, m))
        if old and turn[s] - old[2] >= 6:
            old = None
        want[e] = bool(old and old[0] == content and old[1] >= depth)
        if not want[e]:
            state[(s, m)] = (content, depth, turn[s])
    assert got == want
