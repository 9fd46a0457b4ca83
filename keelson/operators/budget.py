"""Per-query selection under record, token, character and slot budgets.

Inputs are ranked shortlists (at most about a hundred rows per query), so the folds below run on
one small array per query while queries run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.operators import fuse

c = F.col
Q = "query_id"

# Default and ceiling of every budget dimension.
DEFAULT_BUDGET = {"nodes": 8, "edges": 12, "evidence": 8, "tokens": 2000, "graph_hops": 1, "local_tier": 1, "tier_budget": 3, "latency_ms": 250}
CEILING = {"nodes": 50, "edges": 100, "evidence": 50, "tokens": 100_000, "graph_hops": 3, "local_tier": 3, "tier_budget": 50, "latency_ms": 60_000}


def expand_budget(budget: dict[str, int]) -> dict[str, int]:
    """Doubled envelope up to the ceilings; one more hop, same tier."""
    out = {k: min(v * 2, CEILING[k]) for k, v in budget.items()}
    out["graph_hops"] = min(budget["graph_hops"] + 1, CEILING["graph_hops"])
    out["local_tier"] = budget["local_tier"]
    return out


def fibonacci_targets(most: int) -> list[int]:
    limit = max(1, int(most))
    targets, a, b = [1], 1, 2
    while b < limit:
        targets.append(b)
        a, b = b, a + b
    return targets if targets[-1] == limit else targets + [limit]


def greedy_selection(candidates: DataFrame, budget: dict[str, int], limit: int, position: str = "position") -> DataFrame:
    """Skip-and-continue greedy walk: one row per query with selected ids and exhausted flags.

    ``candidates``: query_id, id, node, tier, tokens and the position of the ranked list.
    """
    row = F.struct(c(position).alias("p"), "id", "node", "tier", "tokens")
    lists = candidates.groupBy(Q).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    flag = lambda old, test: old | test
    start = F.struct(
        F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<bigint>").alias("nodes"), F.lit(0).cast("bigint").alias("tokens"),
        F.lit(0).alias("deep"), F.lit(False).alias("x_evidence"), F.lit(False).alias("x_nodes"), F.lit(False).alias("x_deep"), F.lit(False).alias("x_tokens"),
    )

    def step(s: Column, r: Column) -> Column:
        full = F.size(s["ids"]) >= limit
        new_node = ~F.array_contains(s["nodes"], r["node"].cast("bigint"))
        no_node = ~full & new_node & (F.size(s["nodes"]) >= budget["nodes"])
        no_deep = ~full & ~no_node & (r["tier"] >= 2) & (s["deep"] >= budget["tier_budget"])
        no_tokens = ~full & ~no_node & ~no_deep & (F.size(s["ids"]) > 0) & (s["tokens"] + r["tokens"] > budget["tokens"])
        take = ~(full | no_node | no_deep | no_tokens)
        return F.struct(
            F.when(take, F.array_append(s["ids"], r["id"].cast("bigint"))).otherwise(s["ids"]).alias("ids"),
            F.when(take & new_node, F.array_append(s["nodes"], r["node"].cast("bigint"))).otherwise(s["nodes"]).alias("nodes"),
            (s["tokens"] + F.when(take, r["tokens"]).otherwise(0)).cast("bigint").alias("tokens"),
            (s["deep"] + F.when(take & (r["tier"] >= 2), 1).otherwise(0)).alias("deep"),
            flag(s["x_evidence"], full).alias("x_evidence"), flag(s["x_nodes"], no_node).alias("x_nodes"),
            flag(s["x_deep"], no_deep).alias("x_deep"), flag(s["x_tokens"], no_tokens).alias("x_tokens"),
        )

    return lists.select(Q, F.size("rows").alias("available"), F.aggregate("rows", start, step).alias("s")).select(Q, "available", "s.*")


def ledger(selection: DataFrame, budget: dict[str, int]) -> DataFrame:
    """One row per (query, dimension): limit, used, exhausted."""
    dims = [
        ("nodes", budget["nodes"], F.size("nodes"), c("x_nodes")), ("evidence", budget["evidence"], F.size("ids"), c("x_evidence")),
        ("tokens", budget["tokens"], c("tokens"), c("x_tokens")), ("deepEvidence", budget["tier_budget"], c("deep"), c("x_deep")),
    ]
    entries = F.array(*[
        F.struct(
            F.lit(n).alias("dimension"), F.lit(m).cast("bigint").alias("limit"), used.cast("bigint").alias("used"),
            (x | (used >= m)).alias("exhausted"),
        )
        for n, m, used, x in dims
    ])
    return selection.select(Q, F.explode(entries).alias("e")).select(Q, "e.*")


def fibonacci_walk(candidates: DataFrame, most: int, initial: int = 13, strong: int = 3, strong_gap: float = 0.05) -> DataFrame:
    """First cumulative target whose prefix is sufficient.

    ``candidates``: query_id, position, strength, direct, reason. Every prefix's QPP is a running
    window; targets from the starting size are then compared in order.
    """
    running = Window.partitionBy(Q).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = fuse.qpp_decision(candidates.withColumns(fuse.qpp_columns(running)))
    whole = Window.partitionBy(Q)
    n = F.count("*").over(whole)
    second_gap = F.max(F.when(c("position") == 2, c("top_gap"))).over(whole)
    start = F.when(F.coalesce(second_gap, F.lit(0.0)) >= strong_gap, min(initial, strong)).otherwise(initial)
    targets = F.array(*[F.lit(x) for x in fibonacci_targets(most)])
    staged = prefixes.withColumn("_n", n).withColumn("_start", F.least(start, F.lit(most)))
    stages = staged.where(F.array_contains(targets, c("position")) | ((c("position") == c("_n")) & (c("position") < most)))
    stages = stages.where((c("position") >= c("_start")) | (c("position") == c("_n")))
    done = ~c("trigger") | (c("position") >= c("_n")) | (c("position") >= most)
    first = stages.where(done).groupBy(Q).agg(F.min_by(F.struct("position", "trigger", "reason_code", "qpp", "_n", "_start"), "position").alias("s"))
    stop = F.when(~c("s.trigger"), "sufficient").when(c("s.position") >= c("s._n"), "candidate_pool_exhausted").otherwise("budget_exhausted")
    return first.select(Q, c("s._start").alias("start"), c("s.position").alias("selected"), c("s.qpp").alias("qpp"), stop.alias("stopped_because"))


def tier_walk(candidates: DataFrame, max_tier: int) -> DataFrame:
    """Lowest tier whose cumulative set is sufficient, else ``max_tier``."""
    tiers = candidates.withColumn("open", F.explode(F.sequence(F.lit(0), F.lit(max_tier)))).where(c("tier") <= c("open"))
    whole = Window.partitionBy(Q, "open").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = tiers.withColumns(fuse.qpp_columns(whole))
    each = staged.groupBy(Q, "open").agg(*[F.first(x).alias(x) for x in fuse.qpp_columns(whole)])
    decided = fuse.qpp_decision(each)
    enough = decided.groupBy(Q).agg(F.min(F.when(~c("trigger"), c("open"))).alias("tier"))
    return enough.select(Q, F.coalesce("tier", F.lit(max_tier)).alias("opened_tier"))


def warm_fold(candidates: DataFrame, smallest: int = 5) -> DataFrame:
    """With enough tier-1 rows show the first half of them and defer the rest."""
    warm = Window.partitionBy(Q, F.col("tier") == 1)
    order = warm.orderBy("position")
    n, r = F.count("*").over(warm), F.row_number().over(order)
    deferred = (c("tier") == 1) & (n >= smallest) & (r > F.ceil(n / 2))
    return candidates.withColumn("deferred", deferred)


def char_prefix(page: DataFrame, budget: int, chars: str = "chars", position: str = "position") -> DataFrame:
    """Ordered prefix within the character budget; the first row always stays."""
    running = Window.partitionBy(Q).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return page.withColumn("used", F.sum(chars).over(running)).where((c("used") <= budget) | (c(position) == 1))


def fitting_page(page: DataFrame, limit: int, overhead: int = 0, base: int = 5500, default_limit: int = 20, position: str = "position") -> DataFrame:
    """Longest prefix whose rendered size fits the page, scaled with the requested limit."""
    room = base * max(1.0, limit / default_limit)
    running = Window.partitionBy(Q).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    sized = page.where(c(position) <= limit).withColumn("used", F.sum(c("chars") + 1).over(running) + overhead)
    return sized.where(c("used") <= room)


def reserved_page(results: DataFrame, limit: int, neighbours: int = 2, leaves: int = 4) -> DataFrame:
    """Ranked hits with up to two turn neighbours and four group rows in reserved slots.

    ``results``: query_id, id, kind in (ranked, adjacent, leaf), position.
    """
    order = {"ranked": 0, "adjacent": 1, "leaf": 2}
    rank_of = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), c("kind"))
    once = results.withColumn("_k", rank_of).groupBy(Q, "id").agg(F.min_by(F.struct("_k", "kind", "position"), "_k").alias("r")).select(Q, "id", "r.*")
    inside = Window.partitionBy(Q, "_k").orderBy("position", "id")
    numbered = once.withColumn("_r", F.row_number().over(inside))
    all_rows = Window.partitionBy(Q)
    adjacent = F.least(F.count(F.when(c("_k") == 1, 1)).over(all_rows), F.lit(min(neighbours, limit)))
    ranked = F.least(F.count(F.when(c("_k") == 0, 1)).over(all_rows), limit - adjacent)
    room = F.least(F.lit(leaves), limit - adjacent - ranked)
    quota = F.when(c("_k") == 0, ranked).when(c("_k") == 1, adjacent).otherwise(room)
    kept = numbered.withColumn("_q", quota).where(c("_r") <= c("_q"))
    page = Window.partitionBy(Q).orderBy("_k", "_r")
    return kept.withColumn("slot", F.row_number().over(page)).select(Q, "id", "kind", "slot")


PACK_SCHEMA = "query_id bigint, id bigint, characters int, slot int"


def _pack(items, slots: int, characters: int):
    """Best-utility subset under a slot and a character bound (four characters per bucket)."""
    import numpy as np

    usable = items[(items["utility"] > 0) & np.isfinite(items["utility"]) & (items["chars"] <= characters)]
    usable = usable.sort_values(["utility", "position"], ascending=[False, True]).drop_duplicates("key")
    if usable.empty:
        return usable, 0
    if slots == 1:
        return usable.head(1), int(usable["chars"].iloc[0])
    utility = usable["utility"].to_numpy(dtype=np.float32)
    cost = np.ceil((usable["chars"].to_numpy() + 2) / 4).astype(int)
    width = (characters + 2) // 4 + 1
    best = np.full((slots + 1, width), -np.inf, dtype=np.float32)
    best[0, 0] = 0
    taken = np.zeros((len(usable), slots + 1, width), dtype=bool)
    for i, (value, price) in enumerate(zip(utility, cost)):
        if price >= width:
            continue
        offered = best[:-1, : width - price] + value
        better = offered > best[1:, price:]
        taken[i, 1:, price:] = better
        best[1:, price:] = np.where(better, offered, best[1:, price:])
    flat = int(np.argmax(best))
    used, column = divmod(flat, width)
    chosen = []
    for i in range(len(usable) - 1, -1, -1):
        if taken[i, used, column]:
            chosen.append(i)
            used, column = used - 1, column - cost[i]
    picked = usable.iloc[chosen[::-1]]
    if usable["utility"].iloc[0] > picked["utility"].sum():
        return usable.head(1), int(usable["chars"].iloc[0])
    return picked, int(picked["chars"].sum() + 2 * (len(picked) - 1))


def pack_evidence(items: DataFrame, limit: int = 20, characters: int = 2500) -> DataFrame:
    """Two-constraint packing per query; one bounded shortlist is one grouped call.

    ``items``: query_id, id, key, chars, utility, position.
    """
    slots, room = min(limit, 20), min(characters, 2500)

    def run(frame):
        import pandas as pd

        picked, used = _pack(frame, slots, room)
        out = pd.DataFrame({"query_id": picked["query_id"], "id": picked["id"]})
        out["characters"] = used
        out["slot"] = range(1, len(out) + 1)
        return out

    return items.select(Q, "id", "key", "chars", "utility", "position").groupBy(Q).applyInPandas(run, PACK_SCHEMA)


# Character stages of staged recall, characters per slot, slot bounds, length damping.
RECALL_CHARACTERS = (1500, 2000, 2500, 3000, 4000, 5000, 6000, 8000, 12000)
CHARACTERS_PER_SLOT, FEWEST_SLOTS, MOST_SLOTS = 125, 20, 48
RANK_DAMPING, LENGTH_FLOOR, LENGTH_EXPONENT = 40.0, 400, 0.5


def recall_stages(available: int) -> list[tuple[int, int]]:
    """(characters, slots) of every stage below what is available, and the final one."""
    sizes = [x for x in RECALL_CHARACTERS if x < available] + [available]
    return [(x, max(FEWEST_SLOTS, min(MOST_SLOTS, x // CHARACTERS_PER_SLOT))) for x in sizes]


def recall_order(position: Column, chars: Column) -> Column:
    """Rank-damped score divided by a power of the length; short rows are not favoured further."""
    return RANK_DAMPING / (RANK_DAMPING + position - 1) / F.pow(F.greatest(chars, F.lit(LENGTH_FLOOR)), F.lit(LENGTH_EXPONENT))


def _fill_stage(room: int, slots: int):
    """Fold step that admits a row while the stage has a slot and characters left."""

    def step(s: Column, r: Column) -> Column:
        take = (F.size(s["ids"]) < slots) & ~F.array_contains(s["ids"], r["id"].cast("bigint")) & (s["used"] + r["chars"] <= room)
        return F.struct(
            F.when(take, F.array_append(s["ids"], r["id"].cast("bigint"))).otherwise(s["ids"]).alias("ids"),
            (s["used"] + F.when(take, r["chars"]).otherwise(0)).cast("bigint").alias("used"),
        )

    return step


def staged_recall(items: DataFrame, available: int = 12_000) -> DataFrame:
    """Length-damped order, then a slot ladder: each stage opens more characters and slots.

    Rows that do not fit a stage are skipped and tried again in the next one.
    """
    score = F.round(recall_order(c("position"), c("chars")), 12)
    row = F.struct((-score).alias("s"), c("position").alias("p"), "id", c("chars").cast("bigint").alias("chars"))
    lists = items.groupBy(Q).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    state = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("used"))
    out = lists.withColumn("s", state)
    for room, slots in recall_stages(available):
        out = out.withColumn("s", F.aggregate("rows", c("s"), _fill_stage(room, slots)))
    return out.select(Q, "s.ids", "s.used")


def recency_decay(score: Column, event_time: Column, now: Column, half_life_days: float) -> Column:
    """Half the score per half-life; an undated row keeps its score."""
    age = F.greatest(F.lit(0), F.coalesce(F.date_diff(now, event_time), F.lit(0))).cast("double")
    return score * F.pow(F.lit(0.5), age / half_life_days)


def hotness(access_count: Column, importance: Column, idle_days: Column) -> Column:
    recency = 1 / (1 + F.greatest(F.lit(0), F.coalesce(idle_days, F.lit(365))) / 30)
    return F.log2(2 + access_count) * (0.5 + importance) * (0.5 + recency)


def weighted_depths(items: DataFrame, node: str = "node") -> DataFrame:
    """Optimal-code depth of every record inside its node's block (a block is bounded by the
    leaf size; blocks run in parallel)."""

    def run(frame):
        import heapq
        import pandas as pd

        ordered = frame.sort_values("id")
        heap = [(max(2.220446049250313e-16, w), i, [k]) for i, (k, w) in enumerate(zip(ordered["id"], ordered["weight"]))]
        depth = dict.fromkeys(ordered["id"], 0)
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            merged = a[2] + b[2]
            for k in merged:
                depth[k] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, merged))
            serial += 1
        return pd.DataFrame({"block": ordered["block"], "id": ordered["id"], "depth": [depth[k] for k in ordered["id"]]})

    return items.select("block", "id", "weight").groupBy("block").applyInPandas(run, "block string, id bigint, depth int")


def capacity_tiers(depths: DataFrame, capacities: tuple[int, int, int]) -> DataFrame:
    """Tier by cumulative capacity in (depth, id) order of each block."""
    a, b, d = capacities[0], capacities[0] + capacities[1], sum(capacities)
    r = F.row_number().over(Window.partitionBy("block").orderBy("depth", F.col("id").cast("string")))
    return depths.withColumn("tier", F.when(r <= a, 0).when(r <= b, 1).when(r <= d, 2).otherwise(3))
