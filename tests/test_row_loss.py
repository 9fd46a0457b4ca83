"""Rows that an earlier version lost or misjudged."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson import session
from keelson.functions import vocabulary as vb
from keelson.operators import belief, curation, evaluation, lexical, topology
from keelson.streaming import streams


def test_null_type_and_bypass_are_plain(spark):
    rows = [("for this session only, use tabs", None, None), ("still pending review", None, None), ("for this session only, use tabs", "event", False), ("for this session only, use tabs", None, True)]
    df = spark.createDataFrame(rows, "statement string, memory_type string, bypass boolean")
    reason = curation.write_reason(F.col("statement"), F.lit(None).cast("string"), F.col("memory_type"), F.col("bypass"), F.lit(None).cast("timestamp"))
    assert [r["r"] for r in df.select(reason.alias("r")).collect()] == ["non_persistent_instruction", "coordination_state", "allowed", "allowed"]


def test_rows_without_state_key_survive_the_merge(spark):
    local = spark.createDataFrame([("a", None, 1, None), ("b", "k", 1, None)], "id string, state_key string, valid_from int, cached_from string")
    shared = spark.createDataFrame([("c", None, 2), ("d", "k", 2)], "id string, state_key string, valid_from int")
    kept = curation.merge_provisional(local, shared, ["state_key"])
    assert sorted(r["id"] for r in kept.collect()) == ["a", "c", "d"]


def test_prompt_with_a_secret_is_blanked(spark):
    df = spark.createDataFrame([("do you remember my password: hunter2x",), ("do you remember my plan",)], "prompt string")
    assert [r["p"] for r in df.select(vb.recall_input(F.col("prompt")).alias("p")).collect()] == ["", "do you remember my plan"]


def test_long_and_han_triggers(spark):
    long = " ".join(f"word{i}" for i in range(20))
    queries = spark.createDataFrame([(1, f"start {long} end"), (2, "我们上周决定用数据库"), (3, "nothing")], "query_id int, nq string")
    profile = spark.createDataFrame([("x", [long]), ("y", ["数据库"])], "id string, triggers array<string>")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.trigger_matches(queries, profile).collect()}
    assert got == {(1, "x"): len(long), (2, "y"): 3}


def test_any_number_of_supports_has_an_answer(spark):
    counts = spark.createDataFrame([(3,), (500,), (10**9,)], "supported bigint")
    got = {r["supported"]: r["contradictions"] for r in belief.contradictions_to_retract(counts, 0.5).collect()}

    def falls(n, x):
        a, b = 2 + n, 2 + x
        mean = a / (a + b)
        return mean < 0.65 or mean - 1.96 * (mean * (1 - mean) / (a + b + 1)) ** 0.5 < 0.35

    for n, x in got.items():
        assert x == 0 or falls(n, x) and (x == 1 or not falls(n, x - 1))
    assert got[10**9] > 5 * 10**8


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        topology.connected_components(chain, rounds=1)


def test_sign_test_on_large_and_empty_counts(spark):
    df = spark.createDataFrame([(0, 0), (8, 2), (600, 500), (3, 3)], "wins bigint, losses bigint")
    got = [r["p_value"] for r in evaluation.sign_test(df, "wins", "losses").collect()]
    from math import comb

    want = [1.0, *(min(1.0, 2 * sum(comb(w + n, k) for k in range(min(w, n) + 1)) / 2 ** (w + n)) for w, n in ((8, 2), (600, 500), (3, 3)))]
    assert got == pytest.approx(want, abs=1e-8)


def test_keyed_rows_are_in_order_across_chunks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=i), [float(i)]) for i in range(25_000)][::-1]
    spark.createDataFrame(rows, "session bigint, event_id bigint, time timestamp, vector array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session bigint, event_id bigint, time timestamp, vector array<double>").parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["total"] for r in streams.run_to_table(streams.session_average(stream, 0.5)).collect()}
    h = 0.0
    for i in range(25_000):
        h = 0.5 * i + 0.5 * h
        assert got[i] == pytest.approx(h)


def test_backfill_leaves_nothing_pending(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, "t") for i in range(10)], "id bigint, created_at bigint, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "run")
    streams.backfill(stream, lambda: spark.createDataFrame([(4,)], "id bigint"), lambda df: df.select("id"), root, 3)
    got = spark.read.parquet(f"{root}/vectors")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert {r["step"]: r["count"] for r in got.groupBy("step").count().collect()} == {0: 3, 1: 3, 2: 3}


@pytest.mark.parametrize("files", [1, 70])
def test_a_table_is_streamed_whole_as_a_file_or_a_folder(spark, tmp_path, files):
    """A folder of parquet files is one table; its files are one batch, whatever their order."""
    source = tmp_path / "source"
    spark.range(140).repartition(files).write.parquet(str(source))
    if files == 1:
        next(source.glob("*.parquet")).rename(tmp_path / "rows.parquet")
    else:
        source.rename(tmp_path / "rows.parquet")
    batches = []
    stream = streams.parquet_stream(spark, str(tmp_path), "rows")
    streams.run_batches(stream, lambda batch, number: batches.append(sorted(r["id"] for r in batch.collect())), str(tmp_path / "run"))
    assert batches == [list(range(140))]


def test_backfill_reads_a_batch_a_fixed_number_of_times(spark, tmp_path):
    """Rows of one id stay together, and the vectors are asked for once, however many steps there are."""
    rows = spark.createDataFrame([(i // 2, i // 2, "t") for i in range(400)], "id bigint, created_at bigint, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    asked, root = [], str(tmp_path / "run")

    def embed(df):
        asked.append(1)
        return df.select("id")

    streams.backfill(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda: spark.createDataFrame([(4,)], "id bigint"), embed, root, 10)
    got = spark.read.parquet(f"{root}/vectors").groupBy("step").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("step").collect()
    assert len(asked) == 1 and len(got) == 40 and {r["n"] for r in got[:-1]} == {10} and got[-1]["n"] == 8
    assert all(x["low"] > y["high"] for x, y in zip(got, got[1:]))


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.require_shared_folder(Session, None)
    session.require_shared_folder(Session, "hdfs:///shared")


def test_ties_at_six_decimals_go_to_the_smaller_id(spark):
    from keelson.operators import dense

    def vector(x):
        return [x, (1 - x * x) ** 0.5]

    corpus = spark.createDataFrame([(5, vector(0.80000001)), (1, vector(0.79999999)), (7, vector(0.2)), (8, [0.0, 0.0])], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    got = dense.vector_top_k(corpus, asked, 1).collect()
    assert [(r["id"], r["cosine"]) for r in got] == [(1, 0.8)]
    assert dense.vector_top_k(corpus, asked.where("false"), 1).count() == 0


def test_task_window_carries_two_anchors(spark):
    from keelson.streaming import views

    prompts = ["fix parser.py please", "build the docs", "build the docs", "continue", "试一下！", "hello"]
    turns = spark.createDataFrame([(1, i, p) for i, p in enumerate(prompts)], "session bigint, ordinal bigint, prompt string")
    got = {r["ordinal"]: r["context"] for r in views.task_window(turns).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "fix parser.py please\nbuild the docs", 4: "fix parser.py please\nbuild the docs", 5: None}


def test_a_second_upsert_is_a_replay(spark, tmp_path):
    from keelson.sources import sinks

    root = str(tmp_path / "store")
    schema = "key bigint, operation_id bigint, request_hash string, slot bigint, payload bigint"
    first = spark.createDataFrame([(1, 10, "a", 1, 5), (1, 10, "a", 2, 6), (2, 11, "b", 3, 7)], schema)
    state = lambda: sorted(tuple(r) for r in sinks.read_version(spark, root, sinks.current_version(spark, root))[0].collect())
    assert sinks.apply_upsert(spark, root, first).count() == 0 and state() == [(1, 6, 1), (2, 7, 1)]
    assert sinks.apply_upsert(spark, root, first).count() == 0 and state() == [(1, 6, 1), (2, 7, 1)]
    second = spark.createDataFrame([(1, 11, "other", 1, 9), (2, 12, "c", 2, 8)], schema)
    assert [r["key"] for r in sinks.apply_upsert(spark, root, second).collect()] == [1] and state() == [(1, 6, 1), (2, 8, 2)]


def test_entity_filter_and_pages(spark):
    from keelson.operators import filters

    with pytest.raises(ValueError):
        filters.keyset_page(spark.range(3), ["id"], None, 513)
    assert spark.range(3).where(filters.entity_filter(ids=[])).count() == 0
    assert [r["id"] for r in filters.keyset_page(spark.range(9), ["id"], (4,), 2).collect()] == [5, 6]
