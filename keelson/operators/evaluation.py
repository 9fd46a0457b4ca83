"""Retrieval evaluation: gold matching, ranking metrics, paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx
from keelson.session import explode_rows, spread

ANCHOR_WORDS = 5


def containment_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(query_id, id) where the record's words contain the passage's words as a substring.

    A passage of seven or more words matches through five of its interior words, which must be
    whole words of the record: records emit hashes of their five-word windows and meet passages
    in an equi-join. Shorter passages meet on their first three characters among the record's
    distinct character n-grams. Both paths verify with ``contains``; no pair is compared without
    sharing an anchor.
    """
    n = needles.select("query_id", tx.words_only(F.col("needle")).alias("nw")).where("nw <> ''")
    h = spread(haystacks).select("id", tx.words_only(F.col("haystack")).alias("hw"))
    count = F.size(F.split("nw", " "))
    window = lambda words, i: F.xxhash64(F.array_join(F.slice(words, i, ANCHOR_WORDS), " "))
    long = n.where(count >= ANCHOR_WORDS + 2).select("query_id", "nw", window(F.split("nw", " "), F.lit(2)).alias("anchor"))
    words = h.select("id", "hw", F.split("hw", " ").alias("w")).where(F.size("w") >= ANCHOR_WORDS)
    starts = F.sequence(F.lit(1), F.size("w") - (ANCHOR_WORDS - 1))
    hashes = F.array_distinct(F.transform(starts, lambda i: window(F.col("w"), i)))
    anchors = explode_rows(words, hashes, "anchor", "id")
    # Text is joined back only for the few records that share an anchor.
    met = anchors.join(long, "anchor").select("query_id", "id", "nw")
    by_window = met.join(h, "id").where(F.col("hw").contains(F.col("nw"))).select("query_id", "id")
    short = n.where(count < ANCHOR_WORDS + 2).withColumn("g", F.substring("nw", 1, 3))
    distinct = F.array_distinct(F.concat(*[tx.char_ngrams(F.col("hw"), i) for i in (1, 2, 3)]))
    grams = explode_rows(h, distinct, "g", "id").join(short.select("g").distinct(), "g", "left_semi")
    close = grams.join(short, "g").join(h, "id").where(F.col("hw").contains(F.col("nw"))).select("query_id", "id")
    return by_window.unionByName(close).distinct()


def gold_ranks(candidates: DataFrame, golds: DataFrame, direction: str = "gold-in-candidate", ranked_prefix: int | None = None) -> DataFrame:
    """First-hit rank of every gold text among its query's candidates.

    ``candidates``: query_id, rank, text (a bounded page per query); ``golds``: query_id, gold_id,
    gold. Adds ``gold_rank`` over the whole page and ``ranked_gold_rank`` over its ranked prefix.
    """
    g = golds.select("query_id", "gold_id", tx.words_only(F.col("gold")).alias("g")).where("g <> ''")
    page = candidates.select("query_id", "rank", tx.words_only(F.col("text")).alias("c")).where("c <> ''")
    hit = F.col("c").contains(F.col("g")) if direction == "gold-in-candidate" else F.col("g").contains(F.col("c"))
    within = F.lit(True) if ranked_prefix is None else F.col("rank") <= ranked_prefix
    found = (
        g.join(page, "query_id").where(hit).groupBy("query_id", "gold_id")
        .agg(F.min("rank").alias("gold_rank"), F.min(F.when(within, F.col("rank"))).alias("ranked_gold_rank"))
    )
    return g.select("query_id", "gold_id").join(found, ["query_id", "gold_id"], "left")


def question_scores(ranks: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row per question from its gold ranks; ``questions`` carries category, chars and duration."""
    top = max(ks)
    rank = F.col("ranked_gold_rank")
    per = ranks.groupBy("query_id").agg(
        F.count("*").alias("golds"),
        *[F.count_if(rank <= k).alias(f"hits_{k}") for k in ks],
        F.count("gold_rank").alias("hits_full"),
        F.count_if(rank <= top).alias("hits_ranked"),
        F.sum(F.coalesce(1 / rank, F.lit(0.0))).alias("rr_sum"),
        F.min(rank).alias("first_rank"),
    )
    return questions.join(per, "query_id", "left")


def retrieval_metrics(scores: DataFrame, by: str | None = None, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Recall@k, any/all evidence rates, reciprocal ranks, size and latency; ``by`` adds a rollup."""
    top = max(ks)
    c = F.col
    with_gold = c("golds") > 0
    answered = F.count_if(with_gold)
    rate = lambda test: F.round(F.try_divide(F.count_if(with_gold & F.coalesce(test, F.lit(False))), answered), 6)
    nearest = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)")
    aggregates = [
        F.count("*").alias("questions"), answered.alias("questions_with_golds"), F.coalesce(F.sum("golds"), F.lit(0)).alias("golds"),
        *[F.round(F.try_divide(F.sum(f"hits_{k}"), F.sum("golds")), 6).alias(f"recall_{k}") for k in ks],
        rate(c("hits_full") > 0).alias("any_rate"), rate(c("hits_full") == c("golds")).alias("all_rate"),
        rate(c("first_rank") <= top).alias("any_at_k"), rate(c("hits_ranked") == c("golds")).alias("all_at_k"),
        F.round(F.try_divide(F.sum("rr_sum"), F.sum("golds")), 6).alias("mrr_gold"),
        F.round(F.try_divide(F.sum(F.coalesce(1 / c("first_rank"), F.lit(0.0))), answered), 6).alias("mrr_question"),
        F.round(F.avg(F.when(with_gold, c("context_chars"))), 6).alias("mean_context_chars"),
        nearest(0.5).alias("latency_p50"), nearest(0.95).alias("latency_p95"),
    ]
    if by is None:
        return scores.agg(*aggregates)
    return scores.rollup(by).agg(*aggregates).withColumn(by, F.coalesce(by, F.lit("overall")))


c = F.col
EXACT_TERMS = 1000


def coverage_with_exclusions(positions: DataFrame, by: list[str]) -> DataFrame:
    """Any/all/recall percentages; a question with a dataset gap (-2) is excluded, -1 is a miss."""
    per = positions.groupBy(*by, "question_id").agg(
        F.count("*").alias("labels"), F.count_if(c("position") >= 0).alias("found"), F.bool_or(c("position") == -2).alias("gap")
    ).where("not gap")
    pct = lambda a, b: F.round(100 * a / b, 1)
    return per.groupBy(*by).agg(
        F.count("*").alias("n"), pct(F.count_if(c("found") > 0), F.count("*")).alias("any_pct"),
        pct(F.count_if((c("found") == c("labels")) & (c("labels") > 0)), F.count("*")).alias("all_pct"), pct(F.sum("found"), F.sum("labels")).alias("recall_pct"),
    )


def split_labels(labels: Column) -> Column:
    """Composite evidence labels cut at semicolons and commas, trimmed, empties dropped."""
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, r"[;,]\s*")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def eligibility(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Eligible when a question has labels and every one resolves: (question_id, labels, missing, eligible)."""
    exploded = questions.select("question_id", F.explode_outer(split_labels(c("labels"))).alias("label"))
    resolved = exploded.join(known.select("label", F.lit(1).alias("ok")), "label", "left")
    return resolved.groupBy("question_id").agg(
        F.count("label").alias("labels"), F.count_distinct(F.when(c("ok").isNull(), c("label"))).alias("missing")
    ).withColumn("eligible", (c("labels") > 0) & (c("missing") == 0))


LEAF_IDS = 1024  # ids below a leaf of a digest tree, at most
DEEPEST = 12  # hexadecimal digits of a leaf's prefix, at most: 16**12 leaves


def set_digest(ids: DataFrame, column: str, leaf: int = LEAF_IDS) -> DataFrame:
    """Order-free digest of an id set of any size: the root of a hash tree over the hex digits of the ids' hashes.

    The depth is the least at which no leaf holds more than ``leaf`` ids; it and the digest depend on the
    set alone, not on how it is stored. A leaf hashes its sorted ids, a node the digests of its at most
    sixteen children, so no task gathers more than a leaf.
    """
    named = ids.select(c(column).cast("string").alias("id")).where("id is not null").distinct().withColumn("h", F.sha2("id", 256))
    n, depth = named.count(), 0
    while 16**depth * leaf < n:
        depth += 1
    largest = lambda d: named.groupBy(F.substring("h", 1, d).alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while depth < DEEPEST and largest(depth) > leaf:  # hashes spread ids evenly: a level or two
        depth += 1
    digest = lambda parts: F.sha2(F.concat_ws(",", parts), 256)
    tree = named.groupBy(F.substring("h", 1, depth).alias("p")).agg(digest(F.sort_array(F.collect_list("id"))).alias("d"))
    for level in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("p", "d")))  # sixteen at most
        tree = tree.groupBy(F.substring("p", 1, level).alias("_q")).agg(digest(F.transform(children, lambda x: x["d"])).alias("d")).withColumnRenamed("_q", "p")
    return tree.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest")).select("digest", F.lit(n).cast("bigint").alias("ids"), F.lit(depth).alias("depth"))


def paired_outcomes(results: DataFrame, baseline: str) -> DataFrame:
    """Both-pass / only / both-fail counts of every mode against the baseline on shared pairs.

    ``results``: question_id, repeat, mode, passed (one row per pair and mode).
    """
    base = results.where(c("mode") == baseline).select("question_id", "repeat", c("passed").alias("base"))
    pairs = results.where(c("mode") != baseline).join(base, ["question_id", "repeat"])
    return pairs.groupBy("mode").agg(
        F.count("*").alias("pairs"), F.count_if(c("passed") & c("base")).alias("both_pass"), F.count_if(c("passed") & ~c("base")).alias("candidate_only"),
        F.count_if(~c("passed") & c("base")).alias("baseline_only"), F.count_if(~c("passed") & ~c("base")).alias("both_fail"),
    ).withColumn("net_wins", c("candidate_only") - c("baseline_only"))


def sign_test(pairs: DataFrame, wins: str = "candidate_only", losses: str = "baseline_only") -> DataFrame:
    """Exact two-sided binomial p per row.

    The lower tail is summed inside the row from its largest term down, each term the one before it
    times k / (n - k + 1). The j-th term is below exp(-2j² / n) of the first, so 5 square roots of n of
    them (and some for small n) hold all that a double can show; no row is exploded."""
    n, most = c(wins) + c(losses), F.least(c(wins), c(losses))
    top = _log_factorial(n) - _log_factorial(most) - _log_factorial(n - most) - n * F.log(F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        k = most - i + 1  # from the term of k wins to that of k - 1
        term = a["term"] * k / (n - k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    seen = F.least(most, F.lit(64).cast("bigint") + F.ceil(5 * F.sqrt(n.cast("double"))))
    places = F.when(most > 0, F.sequence(F.lit(1).cast("bigint"), seen)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(top) * F.aggregate(places, start, add)["total"]
    return pairs.withColumn("p_value", F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 9)).otherwise(F.lit(1.0)))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact sum for small n, Stirling's series beyond."""
    small = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= EXACT_TERMS, small).otherwise(series)


def wilson(passed: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = passed / total
    z2 = z * z
    centre = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def accuracy_by(results: DataFrame, by: str) -> DataFrame:
    agg = results.groupBy(by).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    low, high = wilson(c("passed"), c("total"))
    return agg.select(by, "passed", "total", F.round(c("passed") / c("total"), 6).alias("accuracy"), F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


def ranked_list_scores(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """recallAny / recallAll / recall / nDCG per query from a bounded ranking (query_id, id, rank)."""
    wanted = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("wanted"))
    return ranked_hit_scores(ranking.join(relevant.distinct(), ["query_id", "id"], "left_semi"), wanted)


def ranked_hit_scores(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same from the relevant rows of the ranking and the number of relevant rows (query_id, wanted).

    Where relevance is a shared class, this needs no row for each relevant pair. The ideal gain is
    summed once for each number that occurs."""
    got = hits.groupBy("query_id").agg(F.count_distinct("id").alias("got"), F.sum(1 / F.log2(c("rank") + 1.0)).alias("dcg"))
    summed = F.aggregate(F.sequence(F.lit(1).cast("bigint"), c("wanted")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    ideals = wanted.select("wanted").distinct().select("wanted", summed.alias("ideal"))
    joined = wanted.join(got, "query_id", "left").fillna({"got": 0, "dcg": 0.0}).join(ideals, "wanted")
    ideal = c("ideal")
    return joined.select(
        "query_id", F.when(c("got") > 0, 1).otherwise(0).alias("recall_any"), F.when(c("got") == c("wanted"), 1).otherwise(0).alias("recall_all"),
        F.round(c("got") / c("wanted"), 6).alias("recall"), F.round(c("dcg") / ideal, 6).alias("ndcg"),
    )


def matched_products(rows: DataFrame, baseline: str) -> DataFrame:
    """Matched-arm metrics of every candidate mode with its blocker counts, all modes in one pass.

    ``rows``: case_id, repeat, mode, success, evidence_kind, evidence_all, tokens, tool_rounds,
    latency_ms, changed. Metrics are null while any blocker remains.
    """
    keys = ["case_id", "repeat"]
    once = rows.groupBy(*keys, "mode").agg(F.count("*").alias("copies"), F.first(F.struct("success", "evidence_kind", "evidence_all", "tokens", "tool_rounds", "latency_ms", "changed")).alias("r"))
    base = once.where(c("mode") == baseline).select(*keys, c("copies").alias("b_copies"), c("r").alias("b"))
    modes = rows.where(c("mode") != baseline).select("mode").distinct()
    expected = base.crossJoin(modes)  # one row per candidate arm
    cand = once.where(c("mode") != baseline).select(*keys, "mode", c("copies").alias("c_copies"), c("r").alias("x"))
    pairs = expected.join(cand, [*keys, "mode"], "full_outer")
    cost_ok = lambda s: (c(f"{s}.tokens") >= 0) & (c(f"{s}.tool_rounds") >= 0) & (c(f"{s}.latency_ms") >= 0)
    problem = (
        F.when(c("b").isNull() | c("x").isNull(), "missing_arm_pair")
        .when(c("b.success").isNull() | c("x.success").isNull(), "missing_binary_task_success")
        .when(c("b.evidence_all").isNull() | c("x.evidence_all").isNull(), "missing_evidence_sufficiency")
        .when(c("b.evidence_kind") != c("x.evidence_kind"), "mismatched_evidence_kind")
        .when(~F.coalesce(cost_ok("b") & cost_ok("x"), F.lit(False)), "missing_cost_telemetry")
    )
    staged = pairs.withColumn("problem", problem)
    clean = lambda col: F.when(c("problem").isNull(), col)
    agg = staged.groupBy("mode").agg(
        F.count(F.when(c("problem").isNull(), 1)).alias("cases"), F.count("problem").alias("pair_blockers"),
        F.sum(F.coalesce(c("b_copies") - 1, F.lit(0)) + F.coalesce(c("c_copies") - 1, F.lit(0))).alias("duplicate_rows"),
        F.bool_or(F.coalesce(c("x.changed") > 0, F.lit(False))).alias("acts"), F.bool_or(F.coalesce(c("b.changed") > 0, F.lit(False))).alias("base_acts"),
        *[F.avg(clean(c(f"{s}.{m}").cast("double"))).alias(f"{p}_{m}") for s, p in (("b", "base"), ("x", "cand")) for m in ("success", "evidence_all", "tool_rounds", "tokens", "latency_ms")],
    )
    blocked = (c("pair_blockers") > 0) | (c("duplicate_rows") > 0) | ~c("acts") | c("base_acts") | (c("cases") == 0)
    metrics = [x for x in agg.columns if x.startswith(("base_", "cand_")) and x != "base_acts"]
    return agg.withColumn("blocked", blocked).withColumns({m: F.when(~blocked, F.round(m, 6)) for m in metrics}).drop("acts", "base_acts")


def product_gate(metrics: DataFrame, tolerance: float = 0.01, factor: float = 1.25, cases: int = 8) -> DataFrame:
    """Promotion checks over matched metrics; a blocked arm fails closed."""
    checks = {
        "enough_cases": c("cases") >= cases, "success_kept": c("cand_success") + tolerance >= c("base_success"),
        "evidence_kept": c("cand_evidence_all") + tolerance >= c("base_evidence_all"),
        "tool_rounds_bounded": c("cand_tool_rounds") <= F.greatest(c("base_tool_rounds") * factor, c("base_tool_rounds") + 1),
        "tokens_bounded": c("cand_tokens") <= F.greatest(c("base_tokens") * factor, c("base_tokens") + 256),
        "latency_bounded": c("cand_latency_ms") <= F.greatest(F.lit(250.0), c("base_latency_ms") * factor),
    }
    filled = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    out = metrics.withColumns(filled)
    passed = ~c("blocked")
    for k in checks:
        passed = passed & c(k)
    return out.withColumn("passed", passed)


def threshold_curve(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision/recall per threshold from one pass: every row counts into the thresholds it clears.

    ``scored``: score, positive, alias, exact_negative. The grid is a literal, so nothing is
    replicated; the counts per threshold are conditional sums.
    """
    t = [F.lit(x) for x in thresholds]
    sums = []
    for i, x in enumerate(thresholds):
        hit = c("score") >= x
        sums += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & c("positive")).alias(f"tp{i}"), F.count_if(hit & c("alias")).alias(f"al{i}"),
                 F.count_if(~hit & c("exact_negative")).alias(f"rn{i}")]
    row = scored.agg(F.count_if("positive").alias("p"), F.count_if("alias").alias("a"), F.count_if("exact_negative").alias("e"), *sums)
    points = F.array(*[F.struct(t[i].alias("threshold"), c(f"n{i}").alias("selected"), c(f"tp{i}").alias("tp"), c(f"al{i}").alias("al"), c(f"rn{i}").alias("rn")) for i in range(len(t))])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return row.select("p", "a", "e", F.explode(points).alias("x")).select(
        "x.threshold", "x.selected", c("x.tp").alias("true_positives"), ratio(c("x.tp"), c("p")).alias("recall"), ratio(c("x.tp"), c("x.selected")).alias("precision"),
        ratio(c("x.al"), c("a")).alias("alias_recall"), ratio(c("x.rn"), c("e")).alias("negative_rejection"),
    )


def rank_auc(scored: DataFrame, by: list[str], bin_width: float = 0.01) -> DataFrame:
    """ROC AUC with half credit for ties, from value counts and a binned running sum of negatives."""
    from keelson.operators.curation import running_sum

    counts = scored.groupBy(*by, "score").agg(F.count_if("positive").alias("pos"), F.count_if(~c("positive")).alias("neg"))
    run = running_sum(counts, by, ["score"], {"neg": "_upto"}, F.floor(c("score") / bin_width))
    won = c("pos") * (c("_upto") - c("neg") + c("neg") / 2)
    return run.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(won).alias("_w")).withColumn(
        "auc", F.round(F.try_divide("_w", c("positives") * c("negatives")), 9)
    ).drop("_w")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str, bin_width: float) -> DataFrame:
    """Tie-averaged ranks per group through value counts (no window over a whole group)."""
    from keelson.operators.curation import running_sum

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running_sum(counts, by, [value], {"_n": "_upto"}, F.floor(c(value) / bin_width))
    return rows.join(run.select(*by, value, (c("_upto") - (c("_n") - 1) / 2).alias(name)), [*by, value])


def spearman(rows: DataFrame, by: list[str], left: str, right: str, widths: tuple[float, float]) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, by, left, "_a", widths[0]), by, right, "_b", widths[1])
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def kendall_tau_b(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Normalised tau-b per question; events missing from one list share a tie rank.

    ``reference`` / ``candidate``: question_id, item, rank. Lists are a question's few events.
    """
    both = reference.select("question_id", "item", c("rank").alias("r")).join(candidate.select("question_id", "item", c("rank").alias("k")), ["question_id", "item"], "full_outer")
    a = both.select("question_id", c("item").alias("i"), F.coalesce("r", F.lit(1 << 30)).alias("r1"), F.coalesce("k", F.lit(1 << 30)).alias("k1"))
    b = both.select("question_id", c("item").alias("j"), F.coalesce("r", F.lit(1 << 30)).alias("r2"), F.coalesce("k", F.lit(1 << 30)).alias("k2"))
    d = a.join(b, "question_id").where("i < j").select("question_id", F.signum(c("r1") - c("r2")).alias("x"), F.signum(c("k1") - c("k2")).alias("y"))
    n = d.groupBy("question_id").agg(
        F.count_if((c("x") == c("y")) & (c("x") != 0)).alias("same"), F.count_if((c("x") == -c("y")) & (c("x") != 0)).alias("opposite"),
        F.count_if((c("x") == 0) & (c("y") != 0)).alias("ref_tie"), F.count_if((c("x") != 0) & (c("y") == 0)).alias("cand_tie"),
    )
    scale = F.sqrt((c("same") + c("opposite") + c("ref_tie")).cast("double") * (c("same") + c("opposite") + c("cand_tie")))
    return n.select("question_id", F.round(F.when(scale == 0, 0.0).otherwise(((c("same") - c("opposite")) / scale + 1) / 2), 6).alias("tau"))


FLIP_GROUPS = 20  # groups up to which all sign patterns are tried


def sign_flip(deltas: DataFrame) -> DataFrame:
    """Exact sign-flip permutation p over at most FLIP_GROUPS group deltas: p_two_sided (null beyond), groups.

    The patterns are a range that Spark deals out; the deltas travel with it as one short array. More
    groups are counted, but neither listed nor tried."""
    groups = deltas.count()
    if groups > FLIP_GROUPS:
        return deltas.agg(F.lit(None).cast("double").alias("p_two_sided"), F.count("*").alias("groups"))
    listed = deltas.agg(F.sort_array(F.collect_list("delta")).alias("d"))  # FLIP_GROUPS at most
    masks = deltas.sparkSession.range(1 << groups).select(c("id").alias("mask")).crossJoin(F.broadcast(listed))  # one row
    signed = F.transform("d", lambda x, i: F.when(F.getbit("mask", i) == 1, x).otherwise(-x))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    staged = masks.select(F.abs(total(signed)).alias("s"), F.abs(total(c("d"))).alias("o"))
    return staged.agg(F.round(F.count_if(c("s") >= c("o") - 1e-12) / F.count("*"), 9).alias("p_two_sided")).withColumn("groups", F.lit(groups).cast("bigint"))


def calibrate_threshold(rows: DataFrame, previous: float, step: float = 0.05, bin_width: float = 0.01) -> DataFrame:
    """Best balanced-accuracy threshold on the training split, clamped to one step from the previous.

    ``rows``: score (0..1), useful (boolean), split. Candidates are midpoints of distinct scores; a
    running count over the distinct scores evaluates all of them in one sorted pass.
    """
    from keelson.operators.curation import running_sum

    counts = rows.where("split = 'train'").groupBy("score").agg(F.count_if("useful").alias("p"), F.count_if(~c("useful")).alias("n"))
    keyed = counts.withColumn("g", F.lit(1))
    run = running_sum(keyed, ["g"], ["score"], {"p": "tp", "n": "fp"}, F.floor(c("score") / bin_width))
    bins = run.withColumn("_bin", F.floor(c("score") / bin_width))
    inside = Window.partitionBy("_bin").orderBy("score")
    heads = bins.groupBy("_bin").agg(F.min("score").alias("h"))
    after = heads.select("_bin", F.lead("h").over(Window.orderBy("_bin")).alias("next_bin"))  # one row per bin, at most 1/bin_width
    staged = bins.withColumn("_next", F.lead("score").over(inside)).join(after, "_bin")
    middle = (c("score") + F.coalesce("_next", "next_bin", F.lit(1.0))) / 2
    totals = counts.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    candidates = staged.select(middle.alias("t"), "tp", "fp")
    fixed = counts.agg(F.count("*")).select(F.explode(F.array(
        F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")))).alias("z")).select("z.*")
    scored = candidates.unionByName(fixed).crossJoin(totals).withColumn("balanced", F.round((c("tp") / c("P") + 1 - c("fp") / c("N")) / 2, 12))
    best = scored.agg(F.max_by("t", F.struct("balanced", -F.abs(c("t") - previous))).alias("unconstrained"), F.max("balanced").alias("balanced"))
    clamp = F.greatest(F.lit(previous - step), F.least(F.lit(previous + step), c("unconstrained")))
    return best.select("unconstrained", F.round("balanced", 9).alias("balanced"), F.round(clamp, 9).alias("threshold"))


def choose_blend(scored: DataFrame, by: str, a: str, b: str, gold: str, widths: tuple[float, float]) -> DataFrame:
    """Blend weight 0…1 (step 0.1) with the best mean rank correlation over groups."""
    grid = scored.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("blend", F.round((1 - c("w") / 10) * c(a) + c("w") / 10 * c(b), 9))
    each = spearman(grid, ["w", by], "blend", gold, widths)
    macro = each.groupBy("w").agg(F.avg("rho").alias("macro"))
    return macro.agg(F.max_by(c("w") / 10, F.struct(F.round("macro", 9), -c("w"))).alias("weight"), F.round(F.max("macro"), 6).alias("macro"))


def citation_counts(pairs: DataFrame, run: int = 5) -> DataFrame:
    """Retrieved and cited evidence per answer; ``pairs``: conv_id, turn, source_turn, ans, tk.

    Runs of tokens are tested inside the row against the one answer text they belong to.
    """
    n = F.size("tk")
    starts = F.sequence(F.lit(1), F.greatest(n - (run - 1), F.lit(1)))
    quoted = F.exists(starts, lambda i: c("ans").contains(F.array_join(F.slice("tk", i, run), " ")))
    cited = F.when(n < run, c("ans").contains(F.array_join("tk", " "))).otherwise(quoted)
    return pairs.select("conv_id", "turn", cited.alias("cited")).groupBy("conv_id", "turn").agg(F.count("*").alias("retrieved"), F.count_if("cited").alias("cited"))


# Reward of each outcome.
REWARDS = {"verified": 0.6, "correctAbstain": 0.3, "insufficient": -0.5, "rejected": -0.2, "falsePositive": -1.0}


def outcome_rewards(rows: DataFrame, tokens: Column, latency_ms: Column, token_price: float, second_price: float, weight: float) -> DataFrame:
    """Labels to outcome (in priority order) to reward; action conflicts are counted, not averaged."""
    outcome = (
        F.when(c("misleading"), "falsePositive").when(c("not_needed"), "rejected").when(c("sufficient") == F.lit(False), "insufficient")
        .when(c("sufficient"), "verified").when(c("noisy"), "rejected")
    )
    reward = F.element_at(F.create_map(*[F.lit(x) for kv in REWARDS.items() for x in kv]), c("outcome"))
    injected = c("action").isin("resurface", "retrieve")
    bad = (c("outcome").isin("verified", "rejected", "falsePositive") & ~injected) | ((c("outcome") == "correctAbstain") & injected)
    cost = weight * (tokens / 1000 * token_price + latency_ms / 1000 * second_price)
    staged = rows.withColumn("outcome", outcome).where("outcome is not null").withColumn("bad", bad).withColumn("reward", reward).withColumn("cost", cost)
    return staged.groupBy("action").agg(
        F.count("*").alias("rows"), F.count_if("bad").alias("violations"), F.round(F.avg(F.when(~c("bad"), c("reward"))), 6).alias("mean_reward"),
        F.round(F.avg(F.when(~c("bad"), c("cost"))), 6).alias("mean_cost"),
    )


def split_summary(rows: DataFrame, group: str, split: str, smallest: int = 5) -> DataFrame:
    """Rows and independent groups per split, groups that span splits, and small-split warnings."""
    per = rows.groupBy(group, split).agg(F.count("*").alias("n"))
    spanning = per.groupBy(group).agg(F.count("*").alias("s")).where("s > 1").agg(F.count("*").alias("spanning"))
    out = per.groupBy(split).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))
    return out.crossJoin(spanning).withColumn("too_few", c("groups") < smallest)  # one summary row


def chronological_split(groups: DataFrame, fraction: float, bin_expr: Column | None = None) -> DataFrame:
    """Newest ceil(fraction·n) whole groups to validation; a single group trains.

    ``groups``: grp, first, rows. The groups are counted by time bin (default: the day), the counts tell
    the bin of the k-th newest group, and only that bin's groups are ranked, so no task sees more.
    """
    binned = groups.withColumn("_bin", F.to_date("first") if bin_expr is None else bin_expr)
    counts = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    newest = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wanted = F.when(total >= 2, F.greatest(F.lit(1), F.ceil(total * fraction)))
    edge_bin = counts.select("_bin", (wanted - F.sum("n").over(newest) + c("n")).alias("place"), "n").where("place between 1 and n")
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc("first"), F.desc("grp")))
    inside = binned.join(F.broadcast(edge_bin.select("_bin", "place")), "_bin").withColumn("_r", place).where("_r = place")
    edge = inside.agg(F.max(F.struct("first", "grp")).alias("edge"))  # one row, null without a boundary
    late = F.coalesce(F.struct("first", "grp") >= c("edge"), F.lit(False))
    return groups.crossJoin(F.broadcast(edge)).select("grp", "rows", F.when(late, "validation").otherwise("train").alias("split"))
