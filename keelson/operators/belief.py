"""Belief in claims from outcome votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col

# Consolidation policy.
POLICY = {"votes": 3, "mean": 0.75, "lower": 0.5, "keep_mean": 0.65, "keep_lower": 0.35}


def posterior_columns(alpha: Column, beta: Column) -> dict[str, Column]:
    """Mean and clamped mean - 1.96 standard errors of a Beta posterior."""
    total = alpha + beta
    mean = F.when(total > 0, alpha / total).otherwise(0.5)
    error = F.sqrt(mean * (1 - mean) / F.greatest(F.lit(1.0), total + 1))
    lower = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - 1.96 * error))
    return {"mean": mean, "lower": lower}


def dedup_votes(votes: DataFrame) -> DataFrame:
    """One vote per (id, claim, task); conflicting repeats are left out (see ``vote_conflicts``)."""
    return votes.groupBy("id", "claim_index", "task").agg(
        F.min_by("outcome", "vote_id").alias("outcome"), F.min_by("weight", "vote_id").alias("weight"), F.count_distinct("outcome").alias("_n")
    ).where("_n = 1").drop("_n")


def vote_conflicts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("id", "claim_index", "task").agg(F.count_distinct("outcome").alias("outcomes"), F.count("*").alias("votes")).where("outcomes > 1")


def posteriors(votes: DataFrame, prior: Column) -> DataFrame:
    """alpha = 1 + 2p plus supported weight, beta = 1 + 2(1-p) plus contradicted weight.

    Sums combine map-side; a claim with a third of all votes is still one row per task.
    """
    weight = lambda outcome: F.sum(F.when(c("outcome") == outcome, c("weight")).otherwise(0.0))
    sums = votes.groupBy("id", "claim_index").agg(weight("supported").alias("s"), weight("contradicted").alias("x"), F.count("*").alias("votes"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior))
    shaped = sums.withColumn("alpha", 1 + 2 * p + c("s")).withColumn("beta", 1 + 2 * (1 - p) + c("x"))
    return shaped.withColumns(posterior_columns(c("alpha"), c("beta"))).drop("s", "x")


def decisions(claims: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Promote when every claim qualifies, retract when any falls below retention, else hold."""
    good = (c("votes") >= policy["votes"]) & (c("mean") >= policy["mean"]) & (c("lower") >= policy["lower"])
    bad = (c("mean") < policy["keep_mean"]) | (c("lower") < policy["keep_lower"])
    agg = claims.groupBy("id").agg(F.bool_and(good).alias("_g"), F.bool_or(bad).alias("_b"), F.count("*").alias("claims"))
    return agg.select("id", "claims", F.when(c("_g"), "promote").when(c("_b"), "retract").otherwise("hold").alias("decision"))


def proposals(judgements: DataFrame) -> DataFrame:
    """Relation proposals per canonical node pair: observations, mean gain, distinct evidence.

    ``judgements``: judgement, source_node, target_node, source_id, target_id, confidence. The pair
    is ordered for ``refines`` and sorted otherwise. Evidence is counted from a distinct union, so
    no unbounded id set is collected.
    """
    a, b = c("source_node"), c("target_node")
    ordered = c("judgement") == "refines"
    keyed = judgements.where("source_node <> target_node").withColumn(
        "key", F.concat_ws(":", F.lit("semantic"), "judgement", F.when(ordered, a).otherwise(F.least(a, b)), F.when(ordered, b).otherwise(F.greatest(a, b)))
    )
    gains = keyed.groupBy("key").agg(F.count("*").alias("observations"), F.avg("confidence").alias("estimated_gain"))
    evidence = keyed.select("key", F.explode(F.array("source_id", "target_id")).alias("e")).distinct().groupBy("key").agg(F.count("*").alias("evidence"))
    return gains.join(evidence, "key")


def contradictions_to_retract(supported: DataFrame, prior: float, policy: dict = POLICY) -> DataFrame:
    """Smallest number of contradictions that retracts a claim with ``supported`` votes.

    More contradictions never raise the mean or its lower bound, so the number is found by halving
    an interval whose upper end retracts for certain: 62 steps for any vote count.
    """
    base = 1 + 2 * prior + c("supported")
    before = posterior_columns(base, F.lit(1 + 2 * (1 - prior)))
    eligible = (c("supported") >= policy["votes"]) & (before["mean"] >= policy["mean"]) & (before["lower"] >= policy["lower"])

    def falls(x: Column) -> Column:
        after = posterior_columns(base, 1 + 2 * (1 - prior) + x)
        return (after["mean"] < policy["keep_mean"]) | (after["lower"] < policy["keep_lower"])

    def halve(interval: Column, _: Column) -> Column:
        middle = F.floor((interval["low"] + interval["high"]) / 2).cast("bigint")
        down = falls(middle)
        return F.when(interval["low"] >= interval["high"], interval).otherwise(
            F.struct(F.when(down, interval["low"]).otherwise(middle + 1).alias("low"), F.when(down, middle).otherwise(interval["high"]).alias("high"))
        )

    ceiling = F.ceil(base / policy["keep_mean"] + 1).cast("bigint")  # below the mean that is kept
    start = F.struct(F.lit(1).cast("bigint").alias("low"), ceiling.alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve)["low"]
    return supported.distinct().select("supported", eligible.alias("eligible"), F.when(~eligible, F.lit(0)).otherwise(found).alias("contradictions"))
