"""Context expansion: neighbouring turns, groups, chains, graph hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx
from keelson.session import cut_lineage

TURN_BLOCK = 512


def previous_turn(turns: DataFrame, key: str = "session", order: str = "ordinal", value: str = "content") -> DataFrame:
    """As-of join with the greatest smaller ordinal of the same session (gaps allowed).

    ``lag`` runs inside blocks of ordinals; the last turn of the previous non-empty block comes
    from one summary row per block, so a session holding a third of all turns is spread out.
    """
    blocked = turns.withColumn("_block", F.floor(F.col(order) / TURN_BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    local = blocked.withColumn("_prev", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = blocked.groupBy(key, "_block").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(key).orderBy("_block")
    carried = last.select(key, "_block", F.lag("_last").over(across).alias("_carry")).where("_carry is not null")
    joined = local.join(carried, [key, "_block"], "left")
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return joined.withColumn("previous", previous).drop("_block", "_prev", "_first", "_carry")


def carry_forward(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Latest earlier non-null ``value`` per key, with the same block scheme as ``previous_turn``."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / TURN_BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_prev", F.last(value, ignorenulls=True).over(inside))
    last = blocked.groupBy(key, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    across = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_block", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    joined = local.join(carried, [key, "_block"])
    return joined.withColumn(name, F.coalesce("_prev", "_carry")).drop("_block", "_prev", "_carry")


def embedding_text(statement: Column, day: Column, previous: Column, limit: int = 240) -> Column:
    """Day and statement, then the previous turn cut to ``limit`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(previous, F.lit("")), r"\s+", " "))
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)
    head = F.concat_ws(" ", day, statement)
    return F.when(flat == "", head).otherwise(F.concat(head, F.lit("\nprevious: "), cut))


c = F.col
Q = "query_id"


def adjacent_turns(sources: DataFrame, turns: DataFrame) -> DataFrame:
    """Previous and next turn of each source turn: two equi-joins on (session, ordinal)."""
    wanted = sources.select(
        "*", F.explode(F.array(
            F.struct((c("ordinal") - 1).alias("at"), F.lit("previous_turn").alias("relation")),
            F.struct((c("ordinal") + 1).alias("at"), F.lit("next_turn").alias("relation")),
        )).alias("w"),
    ).select("*", c("w.at").alias("at"), c("w.relation").alias("relation")).drop("w")
    other = turns.select("session", c("ordinal").alias("at"), c("content").alias("neighbour"))
    return wanted.join(other, ["session", "at"])


def leaf_peers(seeds: DataFrame, members: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """Records sharing a group or the primary evidence with a seed, inside the seed's scope.

    ``seeds``: query_id, id, seed_order (a few per query). ``members``: leaf_id, id, ordinal.
    ``records``: id, scope, evidence_id, created_at. The OR is two equi-joins and a union.
    """
    seeded = seeds.join(records.select("id", "scope", "evidence_id"), "id").select(Q, c("id").alias("seed"), "seed_order", "scope", "evidence_id")
    groups = members.select("leaf_id", c("id").alias("seed"))
    by_leaf = (
        seeded.join(groups, "seed").join(members.select("leaf_id", c("id").alias("peer"), "ordinal"), "leaf_id")
        .select(Q, "peer", "scope", "seed_order", "ordinal")
    )
    by_evidence = seeded.where("evidence_id is not null").join(records.select("evidence_id", c("id").alias("peer")), "evidence_id").select(
        Q, "peer", "scope", "seed_order", F.lit(None).cast("int").alias("ordinal")
    )
    merged = by_leaf.unionByName(by_evidence).groupBy(Q, "peer", "scope").agg(F.min("seed_order").alias("seed_order"), F.min("ordinal").alias("ordinal"))
    fresh = merged.join(seeds.select(Q, c("id").alias("peer")), [Q, "peer"], "left_anti")
    placed = fresh.join(records.select(c("id").alias("peer"), "scope", "created_at"), ["peer", "scope"])
    w = Window.partitionBy(Q).orderBy("seed_order", F.asc_nulls_last("ordinal"), "created_at", "peer")
    return placed.withColumn("place", F.row_number().over(w)).where(c("place") <= limit)


def chain_projection(page: DataFrame, members: DataFrame, chain_edges: DataFrame, chains: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Memberships of a page's records, and chain edges with both ends on the page.

    ``page``: query_id, id, session. Only active chains that are shared or owned by the session.
    """
    open_chains = chains.where("status = 'active'").select("chain_id", "owner_session", "topic")
    seen = page.join(members, "id").join(open_chains, "chain_id").where("owner_session is null or owner_session = session")
    ends = page.select(Q, "session", c("id").alias("source")).join(chain_edges, "source").join(open_chains.drop("topic"), "chain_id").where(
        "owner_session is null or owner_session = session"
    )
    both = ends.join(page.select(Q, c("id").alias("target")), [Q, "target"], "left_semi")
    w = Window.partitionBy(Q).orderBy("edge_order")
    edges = both.withColumn("_r", F.row_number().over(w)).where(c("_r") <= most).drop("_r")
    return seen.select(Q, "id", "chain_id", "position", "topic"), edges.select(Q, "chain_id", "source", "target")


def undirected(edges: DataFrame) -> DataFrame:
    """Traversable steps of an edge table: both ways unless ``direction`` is source->target."""
    out = edges.select("edge_id", c("src").alias("from"), c("dst").alias("to"), "strength", "type")
    back = edges.where("direction <> 'source->target'") if "direction" in edges.columns else edges
    return out.unionByName(back.select("edge_id", c("dst").alias("from"), c("src").alias("to"), "strength", "type"))


def graph_expand(seeds: DataFrame, edges: DataFrame, hops: int, most_relations: int | None = None) -> DataFrame:
    """Bounded breadth-first expansion of many queries at once: (query_id, node, hop, path).

    ``seeds``: query_id, node. Each hop is frontier ⋈ edges, minus visited nodes, with the
    smallest edge as parent; at most three hops, so the plan is unrolled. With ``most_relations`` a query keeps
    that many nodes, nearest first by (hop, path, node), and hands on no more.
    """
    steps = undirected(edges).groupBy("from", "to").agg(F.min("edge_id").alias("edge_id"))
    frontier = seeds.select(Q, "node", F.lit(0).alias("hop"), F.array().cast("array<string>").alias("path"))
    if most_relations is not None:
        # fewer than most_relations nodes and the seeds were there before, so a hub's first steps fill the list
        most_seeds = seeds.groupBy(Q).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        first = F.row_number().over(Window.partitionBy("from").orderBy("edge_id", "to"))
        steps = cut_lineage(steps.withColumn("_r", first).where(c("_r") <= 2 * most_relations + most_seeds).drop("_r"))
    visited = frontier
    for hop in range(1, min(hops, 3) + 1):
        reached = frontier.join(steps, frontier["node"] == steps["from"]).select(
            Q, c("to").alias("node"), F.lit(hop).alias("hop"), F.array_append("path", c("edge_id")).alias("path")
        )
        best = reached.groupBy(Q, "node").agg(F.first("hop").alias("hop"), F.min("path").alias("path"))
        frontier = best.join(visited.select(Q, "node"), [Q, "node"], "left_anti")
        if most_relations is not None:
            rank = F.row_number().over(Window.partitionBy(Q).orderBy("path", "node"))
            frontier = cut_lineage(frontier.withColumn("_r", rank).where(c("_r") <= most_relations).drop("_r"))
        visited = visited.unionByName(frontier)
        if most_relations is not None:
            full = visited.where("hop > 0").groupBy(Q).agg(F.count("*").alias("n")).where(c("n") >= most_relations)
            frontier = frontier.join(full, Q, "left_anti")  # a full list takes nothing from further hops
    if most_relations is None:
        return visited
    w = Window.partitionBy(Q).orderBy("hop", "path", "node")
    nearest = visited.where("hop > 0").withColumn("_r", F.row_number().over(w)).where(c("_r") <= most_relations).drop("_r")
    return visited.where("hop = 0").unionByName(nearest)


def matching_neighbours(anchors: DataFrame, turns: DataFrame, terms: str = "terms", most: int = 2) -> DataFrame:
    """Up to two neighbouring turns of the top anchors that share letter terms with the query.

    ``anchors``: query_id, session, ordinal, rank, terms (already the first two rows per query).
    """
    near = adjacent_turns(anchors, turns.select("session", "ordinal", "content"))
    anchor_keys = anchors.select(Q, "session", c("ordinal").alias("at"))
    fresh = near.join(anchor_keys, [Q, "session", "at"], "left_anti")
    overlap = F.size(F.array_intersect(terms, F.array_distinct(tx.search_terms(tx.match_form(c("neighbour"))))))
    scored = fresh.withColumn("overlap", overlap).where("overlap > 0")
    once = Window.partitionBy(Q, "session", "at").orderBy("rank", "relation")
    w = Window.partitionBy(Q).orderBy(F.desc("overlap"), "rank", F.desc("relation"), "session", "at")
    return scored.withColumn("_o", F.row_number().over(once)).where("_o = 1").withColumn("place", F.row_number().over(w)).where(c("place") <= most).select(
        Q, "session", c("at").alias("ordinal"), "relation", "overlap", "place"
    )


def radius_neighbours(anchors: DataFrame, turns: DataFrame, radius: int = 2, kept: int = 10, cap: int = 20) -> DataFrame:
    """Turns within ``radius`` of the top anchors, round-robin over anchors behind a kept prefix.

    ``anchors``: query_id, session, ordinal, rank (full page; the first five expand). The range
    join is an equi-join on exploded offsets.
    """
    offsets = [d for k in range(1, radius + 1) for d in (-k, k)]
    top = anchors.where("rank <= 5").select(
        Q, "session", "rank", F.posexplode(F.array(*[c("ordinal") + d for d in offsets])).alias("turn_order", "ordinal")
    )
    arm = top.join(turns.select("session", "ordinal"), ["session", "ordinal"]).select(
        Q, "session", "ordinal", F.struct(F.lit(1).alias("block"), c("turn_order").cast("int").alias("a"), c("rank").cast("int").alias("b")).alias("p")
    )
    page = anchors.select(
        Q, "session", "ordinal",
        F.when(c("rank") <= kept, F.struct(F.lit(0).alias("block"), c("rank").cast("int").alias("a"), F.lit(0).alias("b")))
        .otherwise(F.struct(F.lit(2).alias("block"), c("rank").cast("int").alias("a"), F.lit(0).alias("b"))).alias("p"),
    )
    merged = arm.unionByName(page).groupBy(Q, "session", "ordinal").agg(F.min("p").alias("p"))
    w = Window.partitionBy(Q).orderBy("p", "session", "ordinal")
    return merged.withColumn("place", F.row_number().over(w)).where(c("place") <= cap).drop("p")


def chain_activation(hits: DataFrame, members: DataFrame, window: int, floor: float = 0.5, most: int = 20) -> DataFrame:
    """Chain members within ``window`` of a hit, scored 1/(1+distance) + term + importance/2.

    ``hits``: query_id, chain_id, position. ``members``: chain_id, id, position, importance, has_term.
    Positions join on exploded offsets, so a long chain never meets all of its hits.
    """
    near = hits.select(Q, "chain_id", F.explode(F.sequence(c("position") - window, c("position") + window)).alias("position"), c("position").alias("hit"))
    joined = near.join(members, ["chain_id", "position"])
    distance = joined.groupBy(Q, "chain_id", "id", "importance", "has_term").agg(F.min(F.abs(c("position") - c("hit"))).alias("distance"))
    score = 1 / (1 + c("distance")) + F.when(c("has_term"), 1).otherwise(0) + 0.5 * c("importance")
    w = Window.partitionBy(Q).orderBy(F.desc("activation"), "id")
    active = distance.withColumn("activation", F.round(score, 9)).where((c("activation") >= floor) & (c("distance") > 0))
    return active.withColumn("place", F.row_number().over(w)).where(c("place") <= most)


def temporal_groups(page: DataFrame, time: str = "event_time") -> DataFrame:
    """Chronological group number of every dated row of a page; undated rows stay apart (null)."""
    w = Window.partitionBy(Q, c(time).isNull()).orderBy(time)
    return page.withColumn("group_no", F.when(c(time).isNotNull(), F.dense_rank().over(w)))


def compact_chains(edges: DataFrame, budget: int, label: str = "label") -> DataFrame:
    """Shorter of the source-grouped and target-grouped rendering per chain, folded over a budget.

    ``edges``: query_id, chain_id, source, target, chain_order. Chains of a page are bounded by the
    page, and so are the lists built per chain.
    """
    unique = edges.dropDuplicates([Q, "chain_id", "source", "target"])

    def rendered(key: str, other: str, text) -> DataFrame:
        members = unique.groupBy(Q, "chain_id", key).agg(F.array_join(F.sort_array(F.collect_set(other)), " & ").alias("m"))
        lines = members.withColumn("line", text(c(key), c("m")))
        return lines.groupBy(Q, "chain_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias(f"{key}_text"))

    out = rendered("source", "target", lambda k, m: F.concat_ws(" --> ", k, m)).join(
        rendered("target", "source", lambda k, m: F.concat_ws(" --> ", m, k)), [Q, "chain_id"]
    )
    text = F.when(F.length("target_text") < F.length("source_text"), c("target_text")).otherwise(c("source_text"))
    ordered = Window.partitionBy(Q).orderBy("chain_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = out.select(Q, "chain_id", text.alias("text")).withColumn("used", F.sum(F.length("text") + 1).over(ordered))
    return sized.withColumn("folded", c("used") > budget)
