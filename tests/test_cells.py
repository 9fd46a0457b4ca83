"""Two-level cells: every row is placed once, recall is measured, leaves grow with the regions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from keelson.operators import cells as cl, dense


def vectors(spark, n=3000, d=16, groups=40):
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(groups, d))
    # a third of all rows stand around one centre
    of = np.where(np.arange(n) % 3 == 0, 0, draw.integers(0, groups, n))
    rows = centres[of] + 0.3 * draw.normal(size=(n, d))
    return spark.createDataFrame([(i, r.tolist(), int(o % 4)) for i, (r, o) in enumerate(zip(rows, of, strict=True))], "id bigint, embedding array<double>, region int")


def test_rows_are_placed_in_their_nearest_leaf(spark, monkeypatch):
    corpus = vectors(spark)
    monkeypatch.setattr(cl, "SHARD_ROWS", 200)  # the hot cell is cut into many tasks
    found = cl.build(corpus, leaf=100)
    placed = found.placed.toPandas()
    assert sorted(placed["id"]) == list(range(3000)) and found.leaf_count >= 25
    assert len(found.coarse) == round(math.sqrt(30))
    leaves = found.leaves.toPandas().sort_values(["cell", "leaf"])
    for cell, group in placed.groupby("cell"):
        centres = cl.matrix_of(leaves[leaves["cell"] == cell]["centre"])
        assert (group["leaf"].to_numpy() == (cl.matrix_of(group["embedding"]) @ centres.T).argmax(axis=1)).all()
    again = cl.build(corpus.repartition(13), leaf=100).placed.toPandas().sort_values("id")
    assert (again["leaf"].to_numpy() == placed.sort_values("id")["leaf"].to_numpy()).all()


def test_recall_with_few_probes(spark):
    corpus = vectors(spark)
    queries = corpus.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = cl.build(corpus, leaf=100)
    exact = {(r["query_id"], r["id"]) for r in dense.vector_top_k(corpus, queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in cl.neighbours(found, queries, 10, coarse_probes=3, probes=8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    every = {(r["query_id"], r["id"]) for r in cl.neighbours(found, queries, 10, coarse_probes=99, probes=999).collect()}
    assert every == exact


def test_leaves_of_regions(spark):
    corpus = vectors(spark)
    out = cl.region_leaves(corpus, "region", 100, 0.95).toPandas()
    own = out[~out["replica"]]
    assert sorted(own["id"]) == list(range(3000))
    for _, group in own.groupby("region"):
        assert group["leaf"].nunique() == math.ceil(len(group) / 100)
    twice = out.groupby("id")["leaf"].agg(["count", "nunique"])
    assert (twice["count"] == twice["nunique"]).all() and (twice["count"] == 2).any()


def test_cells_of_nothing(spark):
    none = vectors(spark, n=3).where("id > 5")
    found = cl.build(none, leaf=10)
    assert found.leaf_count == 0 and found.placed.count() == 0
