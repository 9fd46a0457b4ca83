"""Operators that must not gather a hot key, a large set or a hub: same results as plain loops, in any layout."""

from __future__ import annotations

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from keelson.operators import curation as cu, evaluation as ev, topology as tp

RNG = random.Random(17)


def test_set_digest_depends_on_the_set_alone(spark):
    ids = spark.range(5000).select(F.col("id"))
    one, many = (ev.set_digest(ids.repartition(n), "id", leaf=64).first() for n in (1, 97))
    assert one == many and one["ids"] == 5000 and 16 ** one["depth"] * 64 >= 5000
    twice = ev.set_digest(ids.unionByName(ids.limit(10)).unionByName(spark.sql("select cast(null as bigint) as id")), "id", leaf=64).first()
    assert twice == one
    assert ev.set_digest(ids.where("id <> 77"), "id", leaf=64).first()["digest"] != one["digest"]
    assert ev.set_digest(ids.where("false"), "id").first()["ids"] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_chronological_split_in_bins(spark, n):
    rows = [(i, RNG.randrange(12) * 40_000, RNG.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "grp bigint, first bigint, rows bigint").withColumn("first", F.timestamp_seconds("first"))
    got = {r["grp"] for r in ev.chronological_split(df, 0.2).where("split = 'validation'").collect()}
    newest = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    assert got == {r[0] for r in newest[: 0 if n < 2 else max(1, math.ceil(n * 0.2))]}
    assert ev.chronological_split(df, 0.2).count() == n


def test_sign_flip_tries_patterns_up_to_its_bound(spark):
    deltas = [0.5, -0.2, 0.9, 0.4, 0.1]
    df = spark.createDataFrame([(x,) for x in deltas], "delta double")
    sums = [abs(sum(x * s for x, s in zip(deltas, signs, strict=True))) for signs in product((1, -1), repeat=5)]
    out = ev.sign_flip(df).first()
    assert out["groups"] == 5 and out["p_two_sided"] == pytest.approx(sum(x >= abs(sum(deltas)) - 1e-12 for x in sums) / 32)
    many = ev.sign_flip(spark.range(21).select(F.col("id").cast("double").alias("delta"))).first()
    assert many["groups"] == 21 and many["p_two_sided"] is None


def test_sign_test_of_large_counts(spark):
    df = spark.createDataFrame([(10, 3), (0, 0), (500_000, 500_900), (7, 7)], "candidate_only bigint, baseline_only bigint")
    got = [r["p_value"] for r in ev.sign_test(df).collect()]
    exact = 2 * sum(math.comb(13, k) for k in range(4)) / 2**13
    z = 899 / math.sqrt(1_000_900)
    assert got[0] == pytest.approx(exact, abs=1e-8) and got[1] == 1.0 and got[3] == 1.0
    assert got[2] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-4)


def test_scope_overlaps_against_all_pairs(spark):
    rows = [
        (i, RNG.choice("ab"), s := RNG.randrange(100), s + RNG.choice([0, 5, 20]), RNG.choice([None, "x", "y"]), RNG.choice([None, 1, 2]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "id bigint, key string, start int, end int, project string, tenant int")
    agree = lambda a, b: a is None or b is None or a == b
    want = {
        a[0]: sum(a is not b and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and agree(a[4], b[4]) and agree(a[5], b[5]) for b in rows)
        for a in rows
    }
    got = cu.scope_overlap_counts(df, "key", ["project", "tenant"], lambda t: F.floor(t / 10)).collect()
    assert {r["id"]: r["overlaps"] for r in got} == want


def test_hop_list_of_a_hub_is_cut_late_enough(spark):
    edges = [(f"e{i:04}", "hub", f"leaf{i}") for i in range(300)] + [(f"a{i}", f"leaf{i}", f"far{i}") for i in range(300)] + [("b0", "seed", "hub")]
    df = spark.createDataFrame(edges, "edge_id string, src string, dst string")
    out = tp.hop_expansions(spark.createDataFrame([(1, "seed")], "query_id int, node string"), df, 3, most_relations=50).collect()
    assert [r["edge_id"] for r in sorted(out, key=lambda r: (r["hop"], r["edge_id"]))] == ["b0", *[f"e{i:04}" for i in range(49)]]
