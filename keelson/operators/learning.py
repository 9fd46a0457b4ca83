"""Model-assisted operators on spark.ml."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col


Q = "query_id"


def relevance_features(candidates: DataFrame, now: Column) -> DataFrame:
    """Seventeen features per candidate: score shape, token and character overlap, record metadata.

    ``candidates``: query_id, id, query, text, position, lexical, vector, route, tier, importance,
    event_time, confidence. Per-query windows run over bounded shortlists.
    """
    from keelson.functions import text as tx
    from keelson.operators import fuse

    w = Window.partitionBy(Q)
    tokens = lambda x: F.array_distinct(tx.matches(F.lower(x), r"[a-z0-9]+|[㐀-鿿]"))
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    chars = lambda x: F.array_distinct(F.filter(F.split(F.regexp_replace(x, r"\s+", ""), ""), lambda ch: ch != ""))
    raw = fuse.raw_score(c("lexical"), c("vector"), c("route"))
    s = candidates.withColumns({"_raw": raw, "_qt": tokens(c("query")), "_st": tokens(c("text")), "_q": flat(c("query")), "_s": flat(c("text"))})
    s = s.withColumns({"_n": F.count("*").over(w), "_mean": F.avg("_raw").over(w), "_sd": F.stddev_pop("_raw").over(w), "_top": F.max("_raw").over(w), "_hit": F.array_intersect("_qt", "_st")})
    df = s.select(Q, F.explode("_hit").alias("t")).groupBy(Q, "t").agg(F.count("*").alias("df"))
    sizes = s.groupBy(Q).agg(F.first("_qt").alias("qt"), F.count("*").alias("n"))
    idf = sizes.select(Q, "n", F.explode("qt").alias("t")).join(df, [Q, "t"], "left").select(Q, "t", F.log(1 + c("n") / F.coalesce("df", F.lit(0.5))).alias("idf"))
    total = idf.groupBy(Q).agg(F.sum("idf").alias("_all"))
    got = s.select(Q, "id", F.explode("_hit").alias("t")).join(idf, [Q, "t"]).groupBy(Q, "id").agg(F.sum("idf").alias("_got"))
    j = s.join(total, Q, "left").join(got, [Q, "id"], "left")
    union = F.size("_qt") + F.size("_st") - F.size("_hit")
    qc = chars(c("_q"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    age = F.greatest(F.lit(0), F.coalesce(F.date_diff(now, c("event_time")), F.lit(30)))
    features = {
        "raw_log": F.log1p("_raw"), "f_vector": c("vector"), "f_route": c("route"), "bounded": fuse.hybrid_score(c("lexical"), c("vector"), c("route")),
        "rel_z": F.when(c("_sd") > 0, (c("_raw") - c("_mean")) / c("_sd")).otherwise(0.0), "rel_ratio": F.when(c("_top") > 0, c("_raw") / c("_top")).otherwise(0.0),
        "rank_norm": F.when(c("_n") > 1, (c("position") - 1) / (c("_n") - 1)).otherwise(0.0), "term_coverage": ratio(F.size("_hit"), F.size("_qt")), "jaccard": ratio(F.size("_hit"), union),
        "idf_coverage": ratio(F.coalesce("_got", F.lit(0.0)), c("_all")), "char_overlap": ratio(F.size(F.array_intersect(qc, chars(c("_s")))), F.size(qc)),
        "phrase_match": F.when((F.length("_q") > 0) & c("_s").contains(c("_q")), 1).otherwise(0), "stmt_len": F.log1p(F.length("text")) / 10, "f_tier": c("tier") / 3,
        "f_importance": c("importance"), "recency_days": F.log1p(age), "f_confidence": F.coalesce("confidence", F.lit(0.5)),
    }
    return j.withColumns({k: v.cast("double") for k, v in features.items()}).drop(*[x for x in j.columns if x.startswith("_")])


FEATURES = (
    "raw_log f_vector f_route bounded rel_z rel_ratio rank_norm term_coverage jaccard idf_coverage char_overlap phrase_match stmt_len f_tier "
    "f_importance recency_days f_confidence"
).split()


def train_scorer(rows: DataFrame, label: str, features: list[str] = FEATURES):
    """Standardised logistic scorer; its probability is already calibrated (a logit model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=features, outputCol="x"), StandardScaler(inputCol="x", outputCol="z"),
        LogisticRegression(featuresCol="z", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_rows(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("model_score", vector_to_array("probability")[1]).drop("x", "z", "rawPrediction", "probability", "prediction")


def learned_gate(scored: DataFrame, floor: float) -> DataFrame:
    return scored.where(c("model_score") >= floor)


def learned_rerank(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy(Q).orderBy(F.desc("model_score"), "position")
    return scored.withColumn("model_rank", F.row_number().over(w))


def pair_examples(rows: DataFrame, label: str, cap: int = 4, seed: int = 7) -> DataFrame:
    """Seeded positive/negative pairs per query: at most ``cap`` negatives for every positive.

    Negatives are numbered in a seeded hash order and each positive takes the next ``cap`` of
    them, so a query with many rows yields cap × positives pairs, never the full product.
    """
    order = Window.partitionBy(Q).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    pos = rows.where(c(label) == 1).withColumn("i", F.row_number().over(order) - 1)
    neg = rows.where(c(label) == 0).withColumn("j", F.row_number().over(order) - 1)
    n = neg.groupBy(Q).agg(F.count("*").alias("n"))
    wanted = pos.join(n, Q).select(Q, c("id").alias("positive"), F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(cap), c("n")).cast("int") - 1), lambda k: (c("i") * cap + k) % c("n"))).alias("j"))
    return wanted.join(neg.select(Q, c("id").alias("negative"), "j"), [Q, "j"]).select(Q, "positive", "negative")


# Context decision features, and which of them are saturating counts.
CONTEXT_KEYS = (
    "contextOccupancy remainingTokenRatio remainingToolRatio topCandidateScore candidateScoreGap candidateCount candidateRedundancy candidateFreshness "
    "stepsSinceVerification consecutiveFailures returnedFromInterruption previousNone previousCue previousResurface previousRetrieve previousReward"
).split()
CONTEXT_COUNTS = ("candidateCount", "stepsSinceVerification", "consecutiveFailures")


def context_features(rows: DataFrame) -> DataFrame:
    """Sixteen values, sixteen missing flags, and the names of out-of-range inputs."""
    values, flags, bad = [], [], []
    for key in CONTEXT_KEYS:
        v = c(key).cast("double")
        if key in CONTEXT_COUNTS:
            values.append(F.when(v.isNull(), 0.0).otherwise(F.least(v, F.lit(32.0)) / 32))
            bad.append(F.when(v < 0, F.lit(key)))
        else:
            low = -1.0 if key == "previousReward" else 0.0
            values.append(F.coalesce(v, F.lit(0.0)))
            bad.append(F.when((v < low) | (v > 1), F.lit(key)))
        flags.append(F.when(v.isNull(), 1.0).otherwise(0.0))
    return rows.select("id", F.array(*values).alias("values"), F.array(*flags).alias("missing"), F.array_compact(F.array(*bad)).alias("violations"))


def without_history(features: DataFrame) -> DataFrame:
    """Ablation: the history half is zeroed and marked missing."""
    return features.withColumn("values", F.transform("values", lambda x, i: F.when(i >= 8, 0.0).otherwise(x))).withColumn(
        "missing", F.transform("missing", lambda x, i: F.when(i >= 8, 1.0).otherwise(x))
    )


def attention_pool(page: DataFrame, neighbourhood: DataFrame, state: DataFrame, temperature: float = 4.0, weights=(1, 1, 1, 1, 1, 1, 1), alpha: float = 0.5) -> DataFrame:
    """Two-level attention context and the weighted blend of seven similarities per candidate.

    ``page`` / ``neighbourhood``: query_id, id, embedding plus ``q`` (the query vector) on the page;
    ``state``: query_id, h1, h2, h3 vectors. Each query holds one bounded page, so its vectors are
    pooled inside one row of arrays.
    """
    import math

    from keelson.functions import vectors as vx

    size = 64
    total = sum(math.exp(x) for x in weights)
    w = [math.exp(x) / total for x in weights]
    dbl = lambda x: x.cast("array<double>")
    softmax = lambda sims: F.transform(sims, lambda x: F.exp(x - F.array_max(sims)) / F.aggregate(F.transform(sims, lambda y: F.exp(y - F.array_max(sims))), F.lit(0.0), lambda s, z: s + z))
    lists = page.groupBy(Q).agg(F.first(dbl(c("q"))).alias("q"), F.sort_array(F.collect_list(F.struct("id", dbl(c("embedding")).alias("v")))).alias("cs"))
    around = neighbourhood.groupBy(Q).agg(F.sort_array(F.collect_list(F.struct("id", dbl(c("embedding")).alias("v")))).alias("ns"))
    s = lists.join(around, Q, "left").join(state, Q)
    s = s.withColumn("cv", F.transform("cs", lambda x: x["v"])).withColumn("nv", F.transform("ns", lambda x: x["v"]))
    s = s.withColumn("a1", F.transform("cv", lambda v: vx.dot(v, c("q")) * temperature)).withColumn("w1", softmax(c("a1")))
    s = s.withColumn("g1", vx.weighted_sum(c("cv"), c("w1"), size))
    s = s.withColumn("a2", F.transform("nv", lambda v: vx.dot(v, c("g1")) * temperature)).withColumn("w2", softmax(c("a2")))
    s = s.withColumn("g2", F.coalesce(vx.weighted_sum(c("nv"), c("w2"), size), c("g1")))
    s = s.withColumn("h1n", F.zip_with("g1", "h1", lambda a, b: alpha * a + (1 - alpha) * b))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    s = s.withColumn("g3", vx.unit(add(add(add(add(c("g1"), c("g2")), c("h1n")), c("h2")), c("h3"))))
    score = lambda v: sum((F.lit(w[i]) * vx.dot(v, c(n)) for i, n in enumerate(("q", "g1", "g2", "g3", "h1n", "h2", "h3"))), F.lit(0.0))
    return s.select(Q, F.explode(F.transform("cs", lambda x: F.struct(x["id"].alias("id"), score(x["v"]).alias("score")))).alias("r")).select(Q, "r.id", "r.score")
