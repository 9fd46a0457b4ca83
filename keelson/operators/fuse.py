"""Score fusion, re-ranking and query-performance signals.

All inputs are per-query candidate lists already cut by a top-k, so a window partition by query
holds at most the list length however large the corpus is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx, vectors as vx
from keelson.operators import filters as fl
from keelson.operators.curation import running_sum

c = F.col
Q = "query_id"


def hybrid_score(lexical: Column, vector: Column, route: Column, weights=(0.5, 0.35, 0.15)) -> Column:
    """Bounded lexical l/(l+10) plus non-negative vector and route parts."""
    bounded = F.when(lexical <= 0, 0.0).otherwise(lexical / (lexical + 10))
    zero = F.lit(0.0)
    return bounded * weights[0] + F.greatest(zero, vector) * weights[1] + F.greatest(zero, route) * weights[2]


def raw_score(lexical: Column, vector: Column, route: Column, weights=(0.5, 0.35, 0.15)) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, lexical) * weights[0] + F.greatest(zero, vector) * weights[1] + F.greatest(zero, route) * weights[2]


def hybrid_union(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer union of two candidate lists keeping both positions."""
    left = lexical.select(Q, "id", c("bm25"), c("rank").alias("lexical_rank"))
    right = vector.select(Q, "id", c("cosine"), c("rank").alias("vector_rank"))
    return left.join(right, [Q, "id"], "full_outer")


def hybrid_candidates(queries: DataFrame, records: DataFrame, each: int = 20, limit: int = 10, dimensions: int = 256) -> DataFrame:
    """Hybrid retrieval on the texts themselves: (query_id, id, bm25, cosine, score, rank).

    Both routes give their best ``each`` records; a record that one route found gets the other one's
    score as well, so the blend compares like with like. ``queries``: query_id, query; ``records``: id, text.
    """
    from keelson.operators import dense, lexical
    from keelson.session import cut_lineage, small_side

    # each is used for the candidates and for the cross-scores
    terms = lexical.query_terms(queries)
    hits = cut_lineage(lexical.bm25_hits(terms, records))
    weighted = cut_lineage(lexical.bm25_weights(terms, hits))
    asked = cut_lineage(dense.hashed_vectors(queries, "query_id", "query", dimensions))
    held = cut_lineage(dense.hashed_vectors(records, "id", "text", dimensions))
    # The hits of a record come together, so its scores are summed and cut to the best ones before they are sent.
    first = lexical.bm25_sums(hits.repartition("id").join(small_side(terms, weighted), "term"))
    found = cut_lineage(lexical.top_k(first, "bm25", each).select(Q, "id").unionByName(dense.vector_top_k(held, asked, each).select(Q, "id")).distinct())
    words = lexical.bm25_sums(small_side(found).join(hits, "id").join(weighted, [Q, "term"]))
    crossed = dense.pair_cosines(found, held, asked).select(Q, "id", "cosine")
    both = found.join(words, [Q, "id"], "left").join(crossed, [Q, "id"], "left")
    both = both.select(Q, "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    return lexical.top_k(both.withColumn("score", F.round(hybrid_score(c("bm25"), c("cosine"), F.lit(0.0)), 9)), "score", limit)


def reciprocal_rank_fusion(routes: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """``routes``: query_id, route, id, position (1-based), weight."""
    best = routes.groupBy(Q, "route", "id").agg(F.min("position").alias("position"), F.first("weight").alias("weight"))
    fused = best.groupBy(Q, "id").agg(
        F.round(F.sum(c("weight") / (constant + c("position"))), 9).alias("score"), F.min("position").alias("best_rank")
    )
    w = Window.partitionBy(Q).orderBy(F.desc("score"), "best_rank", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit)


def _calibrated(name: str, w) -> Column:
    """Centre on the median of positives and scale by their deviation (median only when constant)."""
    positive = F.when(c(name) > 0, c(name))
    median = F.median(positive).over(w)
    constant = F.min(positive).over(w) == F.max(positive).over(w)
    deviation = F.stddev_pop(positive).over(w)
    return (
        F.when(median.isNull(), c(name)).when(constant | (deviation == 0), c(name) - median).otherwise((c(name) - median) / deviation)
    )


def local_log_odds(candidates: DataFrame, vector: str = "cosine", lexical: str = "bm25") -> DataFrame:
    """Fixed 3:1 vector preference over per-query calibrated scores."""
    w = Window.partitionBy(Q)
    v, l = _calibrated(vector, w), _calibrated(lexical, w)
    score = F.when(c(lexical) > 0, (v * 0.75 + l * 0.25) * F.sqrt(F.lit(2.0))).otherwise(v)
    order = Window.partitionBy(Q).orderBy(F.desc("score"), "id")
    return candidates.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order))


def shortlist(hybrid: DataFrame, vector: DataFrame, lexical: DataFrame, limit: int, reserved: int = 20) -> DataFrame:
    """First ``reserved`` hybrid rows, then vector, lexical and hybrid in turn, without repeats.

    Each input: query_id, id, rank. Only ids of the hybrid list qualify.
    """
    head = min(limit, reserved)
    h = hybrid.select(Q, "id", F.when(c("rank") <= head, F.struct(F.lit(0), c("rank"), F.lit(0))).otherwise(F.struct(F.lit(1), c("rank"), F.lit(2))).alias("p"))
    known = hybrid.select(Q, "id")
    side = lambda df, order: df.join(known, [Q, "id"], "left_semi").select(Q, "id", F.struct(F.lit(1), c("rank"), F.lit(order)).alias("p"))
    merged = h.unionByName(side(vector, 0)).unionByName(side(lexical, 1)).groupBy(Q, "id").agg(F.min("p").alias("p"))
    w = Window.partitionBy(Q).orderBy("p")
    return merged.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit).drop("p")


def word_terms(text: Column) -> Column:
    """Distinct lower-case words of two or more characters."""
    return F.array_distinct(F.filter(tx.matches(F.lower(text), r"[\p{L}\p{N}_']+"), lambda t: F.length(t) >= 2))


def tie_rerank(candidates: DataFrame, score: str, position: str) -> DataFrame:
    """Reorder equal-score neighbours by IDF-weighted query coverage.

    ``candidates``: query_id, id, query, text, score and position. The set and the order of
    different scores stay as they are.
    """
    w = Window.partitionBy(Q)
    staged = candidates.withColumn("_q", word_terms(c("query"))).withColumn("_hit", F.array_intersect("_q", word_terms(c("text"))))
    staged = staged.withColumn("_n", F.count("*").over(w))
    df = staged.select(Q, "_n", F.explode("_hit").alias("term")).groupBy(Q, "_n", "term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (c("_n") - c("df") + 0.5) / (c("df") + 0.5))
    coverage = (
        staged.select(Q, "id", F.explode("_hit").alias("term")).join(df.select(Q, "term", weight.alias("w")), [Q, "term"])
        .groupBy(Q, "id").agg(F.round(F.sum("w"), 6).alias("coverage"))
    )
    order = Window.partitionBy(Q).orderBy(F.desc(score), F.desc("coverage"), position)
    joined = staged.join(coverage, [Q, "id"], "left").fillna({"coverage": 0.0})
    return joined.withColumn("rank", F.row_number().over(order)).drop("_q", "_hit", "_n")


def usefulness(score: Column, memory_type: Column, normal_query: Column) -> Column:
    """Score plus the bonus of the record type the query's intent asks for."""
    listing, recommend, assistant = (fl.intent(normal_query, f) for f in ("list_count", "recommend", "assistant"))
    z = F.lit(0.0)
    return (
        score
        + F.when(listing & memory_type.isin("derived", "event", "fact", "state"), 0.25).otherwise(z)
        - F.when(listing & (memory_type == "conversation_evidence"), 0.15).otherwise(z)
        - F.when(listing & (memory_type == "strategy"), 0.1).otherwise(z)
        + F.when(recommend & (memory_type == "preference"), 0.3).otherwise(z)
        + F.when(recommend & (memory_type == "constraint"), 0.15).otherwise(z)
        + F.when(assistant & (memory_type == "conversation_evidence"), 0.25).otherwise(z)
    )


def score_stats(scored: DataFrame, score: str = "score") -> DataFrame:
    """Count, mean, deviation, cv, top two scores and their gap per query."""
    s = c(score)
    stats = scored.groupBy(Q).agg(
        F.count("*").alias("count"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.max(s).alias("top1"),
        F.coalesce(F.get(F.sort_array(F.collect_list(s), asc=False), F.lit(1)), F.lit(0.0)).alias("top2"),
    )
    return stats.withColumn("cv", F.when(c("mean") > 0, c("sd") / c("mean")).otherwise(0.0)).withColumn("gap", c("top1") - c("top2"))


def relevance_gate(candidates: DataFrame, floor: float = 0.05, limit: int | None = None, min_z: float | None = None,
                   max_cv: float | None = None, position: str = "rank") -> DataFrame:
    """Drop rows below the bounded floor or the relative floor; a flat list of three or more abstains.

    ``candidates`` carries lexical, vector, route and a position.
    """
    w = Window.partitionBy(Q)
    raw = raw_score(c("lexical"), c("vector"), c("route"))
    staged = candidates.withColumn("_raw", raw).withColumn("_n", F.count("*").over(w)).withColumn("_mean", F.avg("_raw").over(w))
    staged = staged.withColumn("_sd", F.stddev_pop("_raw").over(w))
    keep = hybrid_score(c("lexical"), c("vector"), c("route")) >= floor
    if max_cv is not None:
        cv = F.when(c("_mean") > 0, c("_sd") / c("_mean")).otherwise(0.0)
        keep = keep & ~((c("_n") >= 3) & (cv < max_cv))
    if min_z is not None:
        keep = keep & ((c("_sd") <= 0) | ((c("_raw") - c("_mean")) / c("_sd") >= min_z))
    kept = staged.where(keep).drop("_raw", "_n", "_mean", "_sd")
    if limit is None:
        return kept
    order = Window.partitionBy(Q).orderBy(position)
    return kept.withColumn("_k", F.row_number().over(order)).where(c("_k") <= limit).drop("_k")


def qpp_columns(prefix) -> dict[str, Column]:
    """QPP components over a window (``prefix``) of rows with strength, direct, reason, position."""
    direct = F.when(c("direct"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("strength"))))
    n = F.count(direct).over(prefix)
    mean, sd = F.avg(direct).over(prefix), F.stddev_pop(direct).over(prefix)
    ordered = F.collect_list(direct).over(prefix)
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    total = F.count("*").over(prefix)
    zero = F.lit(0.0)
    return {
        "top1": F.coalesce(F.max(direct).over(prefix), zero),
        "variance": F.when(n < 2, zero).otherwise(clamp(sd * 2)),
        "nqc": F.when((n < 2) | (mean <= 1e-9), zero).otherwise(clamp(sd / mean)),
        "top_gap": F.when((n < 2) | (first <= 0), zero).otherwise(clamp((first - second) / first)),
        "reason_health": F.when(n == 0, zero).otherwise(F.count(F.when(c("direct") & (c("reason") != "hybrid_match"), 1)).over(prefix) / n),
        "direct_count": n,
        "total_count": total,
        "expansion_dependence": F.when(total == 0, zero).otherwise((total - n) / total),
    }


def qpp_decision(rows: DataFrame, threshold: float = 0.55, weight: float = 0.5, floor: float = 0.2) -> DataFrame:
    """Add qpp, trigger and the ordered reason to rows with QPP components."""
    out = rows.withColumn("qpp", c("top1") + weight * c("nqc")).withColumn("expansion_risk", (1 - c("top1")) * c("expansion_dependence"))
    reason = (
        F.when(c("total_count") == 0, "guardrail_empty")
        .when((c("direct_count") > 0) & (c("reason_health") == 0), "guardrail_all_fallback")
        .when(c("top1") < floor, "guardrail_low_top1")
        .when(c("qpp") < threshold, "below_threshold")
        .otherwise("ok")
    )
    return out.withColumn("reason_code", reason).withColumn("trigger", reason != "ok")


def qpp_per_query(candidates: DataFrame, order: str = "position") -> DataFrame:
    """One row per query with every component and the second-pass decision."""
    whole = Window.partitionBy(Q).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = candidates.withColumns(qpp_columns(whole))
    first = staged.groupBy(Q).agg(*[F.first(x).alias(x) for x in qpp_columns(whole)])
    return qpp_decision(first)


def intent_coverage(candidates: DataFrame) -> DataFrame:
    """Share of a query's intent families whose record types occur; 0.5 when it has none."""
    q = F.lower("query")
    types = candidates.groupBy(Q, "query").agg(F.collect_set("memory_type").alias("types"))
    families = [(fl.intent(q, name), F.arrays_overlap("types", F.array(*[F.lit(x) for x in kinds]))) for name, (_, kinds) in fl.INTENTS.items()]
    matched = sum((F.when(m, 1).otherwise(0) for m, _ in families), F.lit(0))
    covered = sum((F.when(m & hit, 1).otherwise(0) for m, hit in families), F.lit(0))
    return types.select(Q, F.when(matched == 0, 0.5).otherwise(covered / matched).alias("intent_coverage"))


def shape_features(scored: DataFrame, tau: float, score: str = "score", tie: str = "id") -> DataFrame:
    """Eleven shape features of each query's score list."""
    order = Window.partitionBy(Q).orderBy(F.desc(score), tie)
    s, r = c(score), c("_r")
    ranked = scored.withColumn("_r", F.row_number().over(order))
    bend = F.lag(score).over(order) - 2 * s + F.lead(score).over(order)
    ranked = ranked.withColumn("_bend", F.when((r >= 2) & (r <= 9), bend))
    top10 = F.when(r <= 10, s)
    at = lambda k: F.max(F.when(r == k, s))
    agg = ranked.groupBy(Q).agg(
        F.max(s).alias("top1"), at(2).alias("_second"), F.min(top10).alias("_tenth"), F.stddev_pop(top10).alias("top10_std"),
        F.coalesce(F.regr_slope(top10, F.when(r <= 10, r.cast("double"))), F.lit(0.0)).alias("decay_slope"),
        (F.avg(F.when(r <= 3, s)) - F.coalesce(F.avg(F.when((r > 10) & (r <= 30), s)), F.lit(0.0))).alias("bimodal_gap"),
        F.sum(F.when(r <= 5, s)).alias("_five"), F.sum(s).alias("_total"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("_bend"), F.lit(0.0))).alias("elbow"),
        F.count("*").alias("list_length"), F.count_if(s >= tau).alias("nn_above_tau"),
    )
    gap = c("top1") - F.coalesce(c("_second"), F.lit(0.0))
    spread = c("top1") - c("_tenth")
    return agg.select(
        Q, "top1", gap.alias("top_gap"), F.when(spread <= 0, 0.0).otherwise(gap / spread).alias("gap_concentration"), "top10_std",
        "decay_slope", "bimodal_gap", F.when(c("_total") <= 0, 0.0).otherwise(c("_five") / c("_total")).alias("top5_concentration"),
        "elbow", "list_length", "nn_above_tau", (c("top1") - tau).alias("margin_over_tau"),
    )


def surface_features(query: Column) -> dict[str, Column]:
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    letters = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    return {
        "query_chars": F.length(query), "query_words": F.size(words),
        "query_avg_word_length": F.coalesce(F.try_divide(letters, F.size(words)), F.lit(0.0)),
        "query_has_numbers": F.when(query.rlike(r"[0-9]"), 1).otherwise(0),
        "query_punctuation": F.size(tx.matches(query, r"[^\p{L}\p{N}\s]")),
    }


def coverage_threshold(scores: DataFrame, target: float, score: str = "score") -> DataFrame:
    """Score that opens the target share of queries; equal scores open together.

    ``percentile_disc`` of the negated score is the value at ceil(target * n) from the top and
    runs as a partial + final aggregation.
    """
    picked = F.expr(f"-percentile_disc({target}) within group (order by -{score})")
    return scores.agg(picked.alias("threshold"), F.count("*").alias("queries"))


def shortlist_pairs(shortlist: DataFrame, limit: int) -> DataFrame:
    """Ordered pairs inside each query's first ``limit`` rows (at most limit² per query)."""
    top = shortlist.where(c("rank") <= limit)
    left = top.select(Q, c("id").alias("a"), c("rank").alias("a_rank"), c("embedding").alias("ea"))
    right = top.select(Q, c("id").alias("b"), c("rank").alias("b_rank"), c("embedding").alias("eb"))
    return left.join(right, Q).where("a <> b").withColumn("similarity", vx.cosine(vx.as_double(c("ea")), vx.as_double(c("eb"))))


def consistency_rerank(shortlist: DataFrame, limit: int) -> DataFrame:
    """0.7 query cosine + 0.3 mean of the three nearest list members, then a 70/30 rank blend."""
    pairs = shortlist_pairs(shortlist, limit)
    w = Window.partitionBy(Q, "a").orderBy(F.desc("similarity"), "b")
    near = pairs.withColumn("_k", F.row_number().over(w)).where("_k <= 3").groupBy(Q, c("a").alias("id")).agg(F.avg("similarity").alias("near"))
    scored = shortlist.where(c("rank") <= limit).join(near, [Q, "id"]).withColumn("consistency", F.round(0.7 * c("cosine") + 0.3 * c("near"), 9))
    by_score = Window.partitionBy(Q).orderBy(F.desc("consistency"), "rank")
    scored = scored.withColumn("consistency_rank", F.row_number().over(by_score))
    blend = Window.partitionBy(Q).orderBy(F.round(0.7 * c("consistency_rank") + 0.3 * c("rank"), 6), "rank")
    return scored.withColumn("folded_rank", F.row_number().over(blend)).drop("embedding", "near")


def dispersion_features(shortlist: DataFrame, pool: DataFrame) -> DataFrame:
    """Margins, z-score, softmax mass and effective count of the visible list."""
    w = Window.partitionBy(Q)
    soft = F.exp(c("cosine") - F.max("cosine").over(w))
    staged = shortlist.withColumn("_e", soft).withColumn("_p", c("_e") / F.sum("_e").over(w))
    at = lambda k, x: F.max(F.when(c("rank") == k, c(x)))
    agg = staged.groupBy(Q).agg(
        F.avg("cosine").alias("mean_top"), F.stddev_pop("cosine").alias("std_top"), at(1, "cosine").alias("t1"), at(2, "cosine").alias("t2"),
        (at(1, "_p") - at(2, "_p")).alias("mass_gap"), F.exp(-F.sum(c("_p") * F.log(c("_p") + 1e-12))).alias("effective_count"),
    )
    means = pool.groupBy(Q).agg(F.avg("cosine").alias("mean_pool"))
    return agg.join(means, Q).select(
        Q, (c("std_top") / (c("mean_pool") + 1e-9)).alias("nqc"), ((c("t1") - c("t2")) / (c("t1") + 1e-9)).alias("margin"),
        (c("t1") / (c("mean_top") + 1e-9)).alias("over_mean"), ((c("t1") - c("mean_top")) / (c("std_top") + 1e-9)).alias("zscore"),
        "mass_gap", "effective_count",
    )


def coherence_features(shortlist: DataFrame, limit: int = 8) -> DataFrame:
    """Mean pairwise similarity of the list, and how isolated the first row is from ranks 2 to 5."""
    pairs = shortlist_pairs(shortlist, limit)
    return pairs.groupBy(Q).agg(
        F.avg("similarity").alias("coherence"),
        F.avg(F.when((c("a_rank") == 1) & (c("b_rank") <= 5), c("similarity"))).alias("neighbourhood"),
    ).withColumn("isolation", 1 - c("neighbourhood"))


def retained_mass(scored: DataFrame, mass: float = 0.98, score: str = "score", position: str = "position") -> DataFrame:
    """Smallest set carrying the softmax-odds mass; the first row always stays."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce(c(score), F.lit(0.5))))
    w = Window.partitionBy(Q)
    staged = scored.withColumn("_l", F.log(p / (1 - p))).withColumn("_m", F.exp(c("_l") - F.max("_l").over(w)))
    order = Window.partitionBy(Q).orderBy(F.when(c(position) == 1, 0).otherwise(1), F.desc("_m"), position)
    before = F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = before / F.sum("_m").over(w)
    return staged.withColumn("_share", F.round(share, 12)).where((c(position) == 1) | (c("_share") < mass)).drop("_l", "_m", "_share")


def fair_order(rows: DataFrame, scope: str, time: str, tie: str) -> DataFrame:
    """Round-robin over scopes: everybody's oldest row before anybody's second row.

    ``turn`` (row number inside the scope) and ``scope_start`` define the order; the sort over
    them is a distributed range sort, not one global window, and a scope of any size is numbered
    day by day.
    """
    numbered = running_sum(rows.withColumn("_one", F.lit(1)), [scope], [time, tie], {"_one": "turn"}, F.to_date(time)).drop("_one")
    return numbered.join(rows.groupBy(scope).agg(F.min(F.struct(time, tie)).alias("scope_start")), scope)


def clause_fusion(lists: DataFrame, limit: int) -> DataFrame:
    """Union of clause lists: best score per id, how many clauses found it, capped."""
    merged = lists.groupBy(Q, "id").agg(
        F.max("score").alias("score"), F.count_distinct("clause").alias("sources"), F.max_by("clause", F.struct("score", -c("clause"))).alias("best_clause"),
        F.sort_array(F.collect_set("clause")).alias("clauses"),
    )
    w = Window.partitionBy(Q).orderBy(F.desc("score"), "id")
    return merged.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit)


def normalized_fusion(lists: DataFrame, limit: int) -> DataFrame:
    """Min-max per clause list, then the best normalised score per id (constant lists score 1)."""
    w = Window.partitionBy(Q, "clause")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = lists.withColumn("score", F.when(high == low, 1.0).otherwise((c("score") - low) / (high - low)))
    return clause_fusion(scaled, limit)


def clause_contribution(fused: DataFrame) -> DataFrame:
    """Per clause: rows of the final page it surfaced, and rows only it surfaced."""
    each = fused.select(Q, "id", "sources", F.explode("clauses").alias("clause"))
    return each.groupBy("clause").agg(F.count("*").alias("contributed"), F.count_if(c("sources") == 1).alias("exclusive"))


def elbow(scored: DataFrame, score: str = "score", min_relative: float = 0.0) -> DataFrame:
    """Rank before the largest drop, when it exceeds the share of the top score."""
    order = Window.partitionBy(Q).orderBy(F.desc(score), "id")
    ranked = scored.withColumn("_r", F.row_number().over(order)).withColumn("_gap", F.round(c(score) - F.lead(score).over(order), 12))
    best = ranked.groupBy(Q).agg(
        F.max_by("_r", F.struct("_gap", -c("_r"))).alias("at"), F.max("_gap").alias("gap"), F.max(score).alias("top"), F.count("*").alias("n")
    )
    found = (c("n") >= 2) & (c("top") > 0) & (c("gap") > min_relative * c("top"))
    return best.select(Q, F.when(found, c("at")).alias("elbow"), F.when(c("n") < 2, 0).otherwise(c("at")).alias("cliff"), "n")


def adaptive_k(scored: DataFrame, score: str = "score", buffer: int = 5, lowest: int = 1, highest: int = 34) -> DataFrame:
    """Largest-gap rank plus a buffer, clamped, and never past 90% of the list."""
    base = elbow(scored, score)
    k = F.least(F.greatest(c("cliff") + buffer, F.lit(lowest)), F.lit(highest))
    most = F.greatest(F.lit(1), F.floor(c("n") * 0.9))
    return base.select(Q, "elbow", F.when(c("n") < 2, lowest).otherwise(F.least(k, most)).cast("bigint").alias("k"))
