"""Event-log folding, latency histograms, activity roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.operators.curation import running_sum

c = F.col

# The latency histogram.
BUCKETS, LOWEST_MS, HIGHEST_MS = 64, 0.05, 10_000.0


def event_star(events: DataFrame) -> DataFrame:
    """One row per graph: first retrieval, folded label, last attribution and outcome.

    A single aggregation with ordered picks (``min_by`` / ``max_by``), so each graph is combined
    map-side and no event list is collected. A later unlabelled event does not erase a label.
    """
    is_kind = lambda kind: c("kind") == kind
    return events.groupBy("graph").agg(
        F.min(F.when(is_kind("view"), c("event_id"))).alias("retrieval"),
        F.max_by(c("value") > 20, F.when(is_kind("signup") & (c("k") % 3 != 0), c("event_id"))).alias("sufficient"),
        F.max(F.when(is_kind("purchase"), c("event_id"))).alias("attribution"),
        F.max_by("value", F.when(is_kind("click"), c("event_id"))).alias("outcome"),
        F.count_if(is_kind("error")).alias("errors"),
    ).where("retrieval is not null")


def bucket_of(ms: Column) -> Column:
    """Log-scale bucket 0..63 between 0.05 ms and 10 s."""
    import math

    low, high = math.log(LOWEST_MS), math.log(HIGHEST_MS)
    clamped = F.least(F.lit(HIGHEST_MS), F.greatest(F.lit(LOWEST_MS), ms))
    index = F.floor((F.log(clamped) - low) / (high - low) * BUCKETS)
    return F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), index)).cast("int")


def histogram(spans: DataFrame, section: str, ms: str) -> DataFrame:
    """Mergeable state: count, sum and sum of squares per (section, bucket), at most 64 rows each."""
    return spans.groupBy(section, bucket_of(c(ms)).alias("bucket")).agg(
        F.count("*").alias("count"), F.sum(ms).alias("sum"), F.sum(c(ms) * c(ms)).alias("sum_sq")
    )


def merge_histograms(state: DataFrame, section: str) -> DataFrame:
    return state.groupBy(section, "bucket").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"))


def histogram_quantile(state: DataFrame, section: str, ratio: float) -> DataFrame:
    """Interpolated quantile per section from bucket counts."""
    import math

    low, high = math.log(LOWEST_MS), math.log(HIGHEST_MS)
    w = Window.partitionBy(section)
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    staged = state.withColumn("_cum", F.sum("count").over(run)).withColumn("_target", ratio * F.sum("count").over(w))
    edge = lambda b: F.exp(low + b / BUCKETS * (high - low))
    first = staged.where("_cum >= _target").groupBy(section).agg(F.min_by(F.struct("bucket", "count", "_cum", "_target"), "bucket").alias("h"))
    within = c("h._cum") - c("h.count")
    share = (c("h._target") - within) / c("h.count")
    lower, upper = edge(c("h.bucket")), edge(c("h.bucket") + 1)
    return first.select(section, (lower + share * (upper - lower)).alias("quantile"))


def indexed_percentiles(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Floor, nearest-rank and scaled percentile per group.

    The three conventions are order statistics at different indexes. Values are pre-aggregated to
    (value, count), and each index is found in the running count.
    """
    counts = values.groupBy(group, value).agg(F.count("*").alias("n"))
    # eighths of an octave: a group of any number of distinct values is cut into bins in order
    octave = F.signum(c(value)) * F.floor(F.log2(F.abs(c(value)) + 1) * 8)
    sizes = values.groupBy(group).agg(F.count("*").alias("_n"))
    staged = running_sum(counts, [group], [value], {"n": "_end"}, octave).join(sizes, group)
    n = c("_n")
    places = {
        "floor": F.least(n - 1, F.floor(n * q)), "nearest": F.greatest(F.lit(0), F.ceil(n * F.lit(q)) - 1),
        "scaled": F.least(n - 1, F.floor((n - 1) * q + 0.5)),
    }
    pick = lambda place: F.min(F.when(c("_end") > place, c(value)))
    return staged.groupBy(group).agg(F.max("_n").alias("count"), *[pick(p).alias(f"p_{k}") for k, p in places.items()])


def daily_activity(events: DataFrame, day: Column, keys: list[str], value: str) -> DataFrame:
    return events.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.max(value).alias("longest"))


def rejection_counters(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("count"), F.max(time).alias("last_at")).orderBy(F.desc("count"), *keys)


def coverage_report(events: DataFrame) -> DataFrame:
    """Counts by type, method and origin, label coverage, time range and blockers in one pass."""
    kind = lambda k: F.count_if(c("type") == k)
    row = events.agg(
        F.count("*").alias("events"), *[kind(k).alias(n) for k, n in (("view", "retrievals"), ("click", "uses"), ("purchase", "attributions"), ("error", "tool_flow"), ("signup", "feedback"))],
        F.count_if((c("type") == "purchase") & c("verified")).alias("verified_attributions"), F.count_distinct("graph").alias("graphs"),
        F.count_distinct(F.when(c("type") == "signup", c("task"))).alias("semantic_tasks"),
        F.count_if((c("type") == "signup") & c("label").isNotNull()).alias("labelled"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    blockers = F.array_compact(F.array(
        F.when(c("retrievals") == 0, F.lit("no retrieval traces")), F.when(c("semantic_tasks") == 0, F.lit("no semantic task identifiers")),
        F.when(c("labelled") == 0, F.lit("no separately labelled retrieval outcomes")),
    ))
    return row.withColumn("blockers", F.size(blockers).cast("bigint"))


def fold_labels(feedback: DataFrame, order: str, labels: list[str]) -> DataFrame:
    """Latest non-null value per label and graph; mixed origin folds to ``controlled``.

    ``max_by`` over (order, label) pairs is a partial + final aggregation, so a busy graph needs no
    ordered window.
    """
    last = lambda name: F.max_by(name, F.when(c(name).isNotNull(), c(order))).alias(name)
    origin = F.when(F.bool_or(c("origin") == "controlled"), "controlled").otherwise("natural").alias("origin")
    return feedback.groupBy("graph").agg(*[last(x) for x in labels], origin)


def trace_retention(traces: DataFrame, now: Column, max_days: int = 30, max_rows: int = 10_000, per_run: int = 5_000) -> DataFrame:
    """Rows to delete: older than the window or beyond the newest ``max_rows``, oldest first, bounded per run.

    The row-count rule needs only the boundary row, found with a bounded top-k; the rest is a
    filter over the table.
    """
    newest = traces.orderBy(F.desc("created_at"), F.desc("id")).limit(max_rows)
    edge = newest.agg(F.min(F.struct("created_at", "id")).alias("edge"), F.count("*").alias("n"))
    cutoff = now - F.make_dt_interval(F.lit(max_days))
    flagged = traces.join(F.broadcast(edge), how="cross")  # one boundary row
    beyond = (c("n") >= max_rows) & (F.struct("created_at", "id") < c("edge"))
    return flagged.where((c("created_at") < cutoff) | beyond).orderBy("created_at", "id").limit(per_run).select("id", "created_at")
