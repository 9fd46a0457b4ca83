"""Graph topology: co-retrieval edges, summaries, blocks, components, activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx
from keelson.session import cut_lineage, explode_rows, spread

c = F.col
Q = "query_id"

# Words an extractive digest skips.
DIGEST_STOP_WORDS = (
    "the a an and or but if then than that this these those is are was were be been being am do does did has have had "
    "will would can could should shall may might must of to in on at by for with from about into over after before we you "
    "he she it they them his her their our your my me him us i not no yes so up out there here when while near again very "
    "just also 的 了 是 在 我 他 她 它们 和 与 吗 呢 吧"
).split()


def coretrieval_pairs(items: DataFrame) -> DataFrame:
    """Co-occurrence of nodes inside one result page: (a, b, observed, useful), a < b.

    ``items``: basket, node, useful, distinct per (basket, node). A basket is a result page and so
    bounded by the page limit; pair counts combine map-side.
    """
    left = items.select("basket", c("node").alias("a"), c("useful").alias("ua"))
    right = items.select("basket", c("node").alias("b"), c("useful").alias("ub"))
    return left.join(right, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("observed"), F.sum(c("ua") * c("ub")).alias("useful"))


def candidate_edges(pairs: DataFrame, consolidated: DataFrame) -> DataFrame:
    return pairs.join(consolidated, ["a", "b"], "left_anti").withColumn("strength", c("useful") / c("observed"))


def graph_summary(records: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Vertices with record count, their top statements and degree."""
    w = Window.partitionBy("node").orderBy(F.desc("importance"), "id")
    first = records.withColumn("r", F.row_number().over(w)).where(c("r") <= top)
    tops = first.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"].cast("string")), ",").alias("top_ids"))
    counts = records.groupBy("node").agg(F.count("*").alias("records"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return counts.join(tops, "node").join(degree, "node", "left").fillna({"degree": 0})


def supersession_pairs(linked: DataFrame) -> DataFrame:
    """Supersession links summed to node pairs."""
    old = linked.select(c("id").alias("supersedes_id"), c("node").alias("src"))
    return linked.where("supersedes_id is not null").join(old, "supersedes_id").where("src <> node").groupBy("src", c("node").alias("dst")).agg(F.count("*").alias("links"))


def leaf_blocks(records: DataFrame, width: int) -> DataFrame:
    """Blocks of (node, type, tier, id range): count, span, stable digest id, sample.

    The id range bounds a block, so its member list fits one aggregation row.
    """
    item = F.struct("id", F.concat_ws(":", "id", "n_chars").alias("t"))
    blocks = records.groupBy("node", "memory_type", "tier", F.floor(c("id") / width).alias("part")).agg(
        F.count("*").alias("count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sort_array(F.collect_list(item)).alias("m")
    )
    digest = F.sha2(F.array_join(F.transform("m", lambda s: s["t"]), ","), 256)
    sample = F.array_join(F.transform(F.slice("m", 1, 3), lambda s: s["id"].cast("string")), ";")
    return blocks.select("node", "memory_type", "tier", "part", "count", "first_id", "last_id", F.concat(F.lit("leaf_"), F.substring(digest, 1, 24)).alias("block_id"), sample.alias("sample"))


def top_terms(rows: DataFrame, n: int) -> DataFrame:
    """Most frequent terms per group (count desc, term asc). Counts combine map-side."""
    tokens = explode_rows(spread(rows), tx.matches(F.lower("text"), r"[a-z0-9]+|[一-鿿]+"), "w", "group")
    long_enough = F.length("w") >= F.when(c("w").rlike("^[a-z0-9]"), 3).otherwise(2)
    counts = tokens.where(long_enough & ~c("w").isin(DIGEST_STOP_WORDS)).groupBy("group", "w").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group").orderBy(F.desc("n"), "w")
    kept = counts.withColumn("r", F.row_number().over(w)).where(c("r") <= n)
    return kept.groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]), ", ").alias("terms"))


def first_sentences(rows: DataFrame, limit: int) -> DataFrame:
    """First distinct sentences of a group, in id order, up to a character cap.

    Only sentences that can still fit matter: a sentence has at least one character, so the first
    ``limit`` distinct ones per group decide the result and bound the running window.
    """
    sentence = tx.strip(F.regexp_extract("text", r"(?s)^(.*?[.!?。！？]|.*)", 1))
    distinct = rows.select("group", "id", sentence.alias("s")).where("s <> ''").groupBy("group", "s").agg(F.min("id").alias("id"))
    w = Window.partitionBy("group").orderBy("id")
    head = distinct.withColumn("r", F.row_number().over(w)).where(c("r") <= limit)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    used = head.withColumn("used", F.sum(F.length("s") + 1).over(running) - 1)
    return used.where((c("r") == 1) | (c("used") <= limit)).select("group", "id", "s", "used")


# Propagation defaults and the channel of every relation type.
DECAY, THRESHOLD, MOST_HOPS = 0.7, 0.02, 4
REGULATORY = ("contradicts", "supersedes", "exception_to", "same_as", "distinct_from")
BOTH_WAYS_REGULATORY = ("contradicts", "same_as", "distinct_from")
FORWARD = ("causes", "depends_on", "is_a", "part_of")
BACKWARD = ("derived_from", "refines")


def activation_defaults(edges: DataFrame) -> DataFrame:
    """Add direction, fan and rule of each relation type."""
    kind = c("type")
    direction = (
        F.when(kind.isin(*BOTH_WAYS_REGULATORY), "both").when(kind.isin(*REGULATORY), "source->target").when(kind.isin(*FORWARD), "source->target")
        .when(kind.isin(*BACKWARD), "target->source").otherwise("both")
    )
    fan = ~kind.isin("same_as", "distinct_from", *BACKWARD)
    return edges.withColumn("direction", direction).withColumn("fan", fan).withColumn("rule", F.when(kind.isin(*REGULATORY), "regulatory").otherwise("conductive"))


def directed_steps(edges: DataFrame) -> DataFrame:
    ahead = edges.where("direction <> 'target->source'").withColumns({"from": c("src"), "to": c("dst")})
    back = edges.where("direction <> 'source->target'").withColumns({"from": c("dst"), "to": c("src")})
    return ahead.unionByName(back)


def spread_activation(seeds: DataFrame, edges: DataFrame, hops: int = 1, decay: float = DECAY, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Best-path spreading activation of many queries: (node activations, edge activations).

    ``seeds``: query_id, node, activation. Each hop joins active nodes with their steps, dilutes by
    the fan-out, and keeps the best value per (query, node) with ``max_by``; the state is
    checkpointed per hop.
    """
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    steps = directed_steps(activation_defaults(edges))
    fan = steps.where("fan").groupBy("from").agg(F.count("*").alias("out"))
    steps = cut_lineage(steps.join(fan, "from", "left").select("edge_id", "from", "to", "type", "strength", "rule", "fan", F.coalesce("out", F.lit(1)).alias("out")))
    nodes = seeds.select(Q, "node", clamp(c("activation")).alias("activation"), F.array().cast("array<string>").alias("path"))
    found = None
    for hop in range(1, min(hops, MOST_HOPS) + 1):
        source = nodes.where("activation > 0").select(Q, c("node").alias("from"), c("activation").alias("s"), "path")
        target = nodes.select(Q, c("node").alias("to"), c("activation").alias("t"))
        fired = source.join(steps, "from").join(target, [Q, "to"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
        dilution = F.when(c("fan"), 1 + F.log(F.greatest(F.lit(1), c("out")))).otherwise(1.0)
        base = clamp(c("s") * c("strength") * (decay ** hop) / dilution)
        shaped = F.when(c("type") == "contradicts", base * F.abs(c("s") - c("t"))).when(c("type").isin("supersedes", "exception_to"), base * (1 - c("t"))).otherwise(base)
        fired = fired.withColumn("a", F.round(clamp(shaped), 12)).where(c("a") >= threshold).withColumn("hop", F.lit(hop))
        rows = fired.select(Q, "edge_id", "from", "to", "a", "rule", "hop")
        found = rows if found is None else found.unionByName(rows)
        gained = fired.where((c("rule") != "regulatory") & (c("a") > c("t")))
        best = gained.groupBy(Q, c("to").alias("node")).agg(
            F.max("a").alias("new"), F.min_by(F.array_append("path", c("edge_id")), F.struct(-c("a"), c("edge_id"))).alias("new_path")
        )
        merged = nodes.join(best, [Q, "node"], "full_outer").select(
            Q, "node", F.coalesce("new", "activation").alias("activation"), F.coalesce("new_path", "path").alias("path")
        )
        nodes = cut_lineage(merged)
    edge_best = found.groupBy(Q, "edge_id").agg(F.max("a").alias("activation"), F.min_by(F.struct("from", "to", "rule", "hop"), F.struct(-c("a"), "hop", "from")).alias("s"))
    return nodes, edge_best.select(Q, "edge_id", "activation", "s.*")


def strength_updates(outcomes: DataFrame, start: float, rate: float = 0.05) -> DataFrame:
    """Clamped prediction-error updates per edge in time order.

    ``outcomes``: edge, time, tie, bucket, outcome, predicted, coactivation. One update is
    x -> clamp(x + d) and such functions compose into (shift, low, high), so every bucket folds its
    own short list and only one triple per bucket is folded per edge.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    delta = rate * (unit(c("outcome")) - unit(c("predicted"))) * unit(c("coactivation"))
    identity = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("l"), F.lit(float("inf")).alias("h"))

    def then(f: Column, g: Column) -> Column:
        inside = lambda x: F.greatest(g["l"], F.least(g["h"], x))
        return F.struct((f["d"] + g["d"]).alias("d"), inside(f["l"] + g["d"]).alias("l"), inside(f["h"] + g["d"]).alias("h"))

    step = F.struct("time", "tie", delta.alias("d"))
    lists = outcomes.groupBy("edge", "bucket").agg(F.sort_array(F.collect_list(step)).alias("x"))
    fold = F.aggregate("x", identity, lambda s, r: then(s, F.struct(r["d"].alias("d"), F.lit(0.0).alias("l"), F.lit(1.0).alias("h"))))
    parts = lists.select("edge", "bucket", F.size("x").alias("n"), fold.alias("f"))
    ordered = parts.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("bucket", "f"))).alias("p"), F.sum("n").alias("updates"))
    whole = F.aggregate("p", identity, lambda s, r: then(s, r["f"]))
    final = lambda f: F.greatest(f["l"], F.least(f["h"], start + f["d"]))
    return ordered.withColumn("_f", whole).select("edge", "updates", final(c("_f")).alias("strength"))


def association_edges(nodes: DataFrame, connected: DataFrame, limit: int) -> DataFrame:
    """Unordered pairs of a result's nodes that no stored edge connects, in result order.

    ``nodes``: query_id, node, position (a page's few nodes). ``connected``: a, b with a <= b.
    """
    left, right = nodes.select(Q, c("node").alias("x"), c("position").alias("i")), nodes.select(Q, c("node").alias("y"), c("position").alias("j"))
    pairs = left.join(right, Q).where("i < j").select(Q, "i", "j", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    fresh = pairs.join(connected, ["a", "b"], "left_anti")
    w = Window.partitionBy(Q).orderBy("i", "j")
    return fresh.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit).select(Q, "a", "b", "rank")


def hop_expansions(seeds: DataFrame, edges: DataFrame, hops: int, most_relations: int) -> DataFrame:
    """Relations reached per hop, each once, the first ``most_relations`` of a query by (hop, edge): (query_id, edge_id, source, target, hop).

    Of a node's edges the first 2 * most_relations can be in the list: at most most_relations of them were
    used before, or the list is full. So a hub hands on that many, however many edges it has.
    """
    ends = edges.select("edge_id", c("src").alias("source"), c("dst").alias("target"), F.lit(0).alias("o")).unionByName(
        edges.select("edge_id", c("dst").alias("source"), c("src").alias("target"), F.lit(1).alias("o"))
    )
    first = F.row_number().over(Window.partitionBy("source").orderBy("edge_id", "o"))
    near = cut_lineage(ends.withColumn("_r", first).where(c("_r") <= 2 * most_relations).drop("_r"))
    visited = seeds.select(Q, "node")
    frontier, used, out = visited, None, None
    for hop in range(1, hops + 1):
        reached = frontier.join(near, c("node") == c("source")).select(Q, "edge_id", "source", "target", "o")
        step = reached.groupBy(Q, "edge_id").agg(F.min_by(F.struct("source", "target"), F.struct("o", "source")).alias("s")).select(Q, "edge_id", "s.source", "s.target")
        if used is not None:
            step = step.join(used, [Q, "edge_id"], "left_anti")
        step = step.withColumn("hop", F.lit(hop))
        out = step if out is None else out.unionByName(step)
        used = out.select(Q, "edge_id")
        frontier = step.select(Q, c("target").alias("node")).distinct().join(visited, [Q, "node"], "left_anti")
        visited = visited.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy(Q).orderBy("hop", "edge_id"))
    return out.withColumn("_r", rank).where(c("_r") <= most_relations).drop("_r")


def connected_components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest reachable label per vertex: (node, component). ``pairs``: a, b of one type.

    Every round takes the minimum label of the neighbours (combined map-side, so hubs are cheap)
    and then jumps pointers, which halves the remaining distance; a checkpoint cuts the lineage. Its joins
    sort both sides: labels that look small would be gathered in the driver to be broadcast, every round anew.
    """
    links = cut_lineage(pairs.select("a", "b").unionByName(pairs.select(c("b").alias("a"), c("a").alias("b"))).where("a <> b").distinct())
    labels = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", c("node")))
    for _ in range(rounds):
        near = links.join(labels.select(c("node").alias("b"), "component").hint("merge"), "b").groupBy(c("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near.hint("merge"), "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), c("component").alias("old"))
        jump = hooked.select(c("node").alias("component"), c("component").alias("root"))
        moved = cut_lineage(hooked.join(jump.hint("merge"), "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds; raise the bound")


FOREST_ROWS = 4096


def similarity_forest(vectors: DataFrame, block: str, threshold: float) -> DataFrame:
    """Spanning edges of the cosine >= threshold graph inside each block: (a, b).

    A block is cut into shards of bounded size and every shard pair is one grouped task. A task
    links its rows with a local union-find and emits only a spanning forest, so a block of copies
    yields as many edges as it has rows, never all pairs, and connectivity is exact.
    """
    sizes = vectors.groupBy(block).agg(F.ceil(F.count("*") / FOREST_ROWS).cast("int").alias("shards"))
    placed = vectors.join(sizes, block).select(block, "id", "embedding", "shards", F.pmod(F.xxhash64("id"), c("shards")).cast("int").alias("s"))
    cell = F.explode(F.sequence(F.lit(0), c("shards") - 1))
    cells = placed.select(block, "id", "embedding", "s", cell.alias("t")).select(block, "id", "embedding", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"))

    def link(frame):
        import numpy as np
        import pandas as pd

        ids = frame["id"].to_numpy()
        m = np.vstack(frame["embedding"].to_list()).astype("float64")
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        parent = np.arange(len(ids))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for start in range(0, len(ids), 512):
            rows, cols = np.nonzero(m[start : start + 512] @ m.T >= threshold)
            for r, k in zip(rows + start, cols):
                if r < k:
                    x, y = root(r), root(k)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((ids[r], ids[k]))
        return pd.DataFrame(out, columns=["a", "b"])

    return cells.groupBy(block, "i", "j").applyInPandas(link, "a bigint, b bigint")


def group_centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Element-wise mean vector per group; partial sums combine map-side per (group, position)."""
    parts = vectors.select(group, F.posexplode("embedding").alias("p", "x")).groupBy(group, "p").agg(F.avg(c("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def weighted_probe(anchors: DataFrame, weight: str) -> DataFrame:
    """Normalised weighted mean of each query's few anchor vectors: (query_id, embedding)."""
    parts = anchors.select(Q, c(weight).alias("w"), F.posexplode("embedding").alias("p", "x")).groupBy(Q, "p").agg((F.sum(c("w") * c("x")) / F.sum("w")).alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"])
    mean = parts.groupBy(Q).agg(vector.alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(Q, F.transform("v", lambda x: x / F.greatest(size, F.lit(1e-12))).alias("embedding"))
