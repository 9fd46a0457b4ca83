"""Soft set logic over memberships, and gated greedy traversal of a shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import vectors as vx

c = F.col
Q = "query_id"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def membership(vector: Column, atom: Column, temperature: float) -> Column:
    return sigmoid(temperature * vx.cosine(vx.as_double(vector), vx.as_double(atom)))


def both(a: Column, b: Column) -> Column:
    return a * b


def either(a: Column, b: Column) -> Column:
    return a + b - a * b


def negate(a: Column) -> Column:
    return 1 - a


def exclusive(a: Column, b: Column) -> Column:
    return both(either(a, b), negate(both(a, b)))


def traverse(nodes: DataFrame, queries: DataFrame, steps: int, decay: float = 0.5, retention: float = 0.5, bias: float = 0.0) -> DataFrame:
    """Greedy gated walk of every query over its own candidate nodes: (query_id, step, id, score).

    A node v enters the query vector through the gate sigmoid(v·q + bias); the next vector is
    retention·(decay·q + gate·v) + (1-retention)·anchor, and v scores by its dot product with it.
    Each step takes the best unvisited node per query (``max_by``). Queries advance together: one
    join and one aggregation per step, and the step count bounds the plan.
    """
    q = vx.as_double(c("q"))
    state = queries.select(Q, q.alias("cur"), q.alias("anchor"), F.array().cast("array<bigint>").alias("seen"))
    found = None
    for step in range(1, steps + 1):
        v = vx.as_double(c("embedding"))
        open_nodes = nodes.join(state, Q).where(~F.array_contains("seen", c("id"))).select(Q, "id", v.alias("v"), "cur", "anchor", "seen")
        gated = open_nodes.withColumn("gate", sigmoid(vx.dot(c("v"), c("cur")) + bias))
        absorbed = F.zip_with("cur", "v", lambda a, x: retention * (decay * a + c("gate") * x))
        moved = gated.withColumn("next", F.zip_with(absorbed, "anchor", lambda a, o: a + (1 - retention) * o))
        scored = moved.withColumn("score", F.round(vx.dot(c("next"), c("v")), 9))
        best = scored.groupBy(Q).agg(F.max_by(F.struct("id", "next", "anchor", "seen", "score"), F.struct("score", -c("id"))).alias("b")).select(Q, "b.*")
        row = best.select(Q, F.lit(step).alias("step"), "id", "score")
        found = row if found is None else found.unionByName(row)
        state = best.select(Q, c("next").alias("cur"), "anchor", F.array_append("seen", c("id")).alias("seen"))
    return found


def what_if(base: DataFrame, changed: DataFrame) -> DataFrame:
    """Difference of two walks per node: scores on both sides and whether the node entered or left."""
    a, b = base.select(Q, "id", c("score").alias("score_before")), changed.select(Q, "id", c("score").alias("score_after"))
    j = a.join(b, [Q, "id"], "full_outer")
    change = F.when(c("score_before").isNull(), "entered").when(c("score_after").isNull(), "exited").otherwise("none")
    return j.select(Q, "id", F.coalesce("score_before", F.lit(0.0)).alias("score_before"), F.coalesce("score_after", F.lit(0.0)).alias("score_after"), change.alias("path_change"))
