"""Structured Streaming operators. Every function maps a streaming DataFrame to another one, or
runs one with ``foreachBatch``; batch twins live in ``keelson.streaming.views``."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.operators import belief, curation, telemetry
from keelson.session import require_shared_folder
from keelson.sources import sinks

c = F.col


def stream_root(spark: SparkSession) -> str:
    """Folder for stream checkpoints and outputs: the cluster's shared one, or in local mode a test folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = configured or "/tmp"
    require_shared_folder(spark, configured)
    if configured:
        return os.path.join(base, f"keelson-{spark.sparkContext.applicationId}-{next(_serial)}")
    return tempfile.mkdtemp(prefix="spark-", dir=base)


def _count() -> Iterator[int]:
    n = 0
    while True:
        yield n
        n += 1


_serial = _count()


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over one table, which is a parquet file or a folder of such files.

    The path is a pattern, for a stream takes no single file by its name. A table's files come in no order
    of time, so all that are there make one micro-batch: in several, the later ones would be late rows."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


def run_to_table(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Run an append stream over everything available and read back what it wrote."""
    spark = stream.sparkSession
    root = root or stream_root(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def policy_split(stream: DataFrame, root: str) -> None:
    """Classified ingest with accepted, rejected and audit outputs per micro-batch.

    ``stream``: id, statement, evidence, memory_type, bypass, expires_at. Each batch writes its own
    folder and overwrites it on a retry, so a replayed batch leaves no duplicates.
    """
    reason = curation.write_reason(c("statement"), c("evidence"), c("memory_type"), c("bypass"), c("expires_at"))

    def handle(batch: DataFrame, number: int) -> None:
        classified = batch.withColumn("reason", reason).persist()
        for name, frame in sinks.split_writes(classified).items():
            frame.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        classified.unpersist()

    run_batches(stream, handle, root)


def dedup_messages(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First message per key inside the watermark; later repeats are ignored."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_posteriors(stream: DataFrame, prior: float, root: str) -> None:
    """Update-mode posterior sums; every batch rewrites the claims it touched under its own folder."""
    agg = belief.posteriors(stream, F.lit(prior))
    run_batches(agg, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/claims/batch={number}"), root, mode="update")


def rolling_histograms(stream: DataFrame, section: str, ms: str, time: str, width: str, slide: str, delay: str) -> DataFrame:
    """Sliding-window latency histograms per section."""
    bucket = telemetry.bucket_of(c(ms)).alias("bucket")
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide), section, bucket).agg(
        F.count("*").alias("count"), F.sum(ms).alias("sum")
    ).select(c("window.start").alias("start"), section, "bucket", "count", "sum")


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Gap-based sessions of trace events."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events")).select(
        key, c("session_window.start").alias("start"), c("session_window.end").alias("end"), "events"
    )


def expiries(entries: DataFrame, pins: DataFrame, delay: str) -> DataFrame:
    """Board entries left-joined with a pin that arrives before they expire (stream-stream join).

    ``entries``: entry_id, created_at, expires_at. ``pins``: pin_entry, pinned_at. The interval
    condition bounds the state on both sides.
    """
    e = entries.withWatermark("created_at", delay)
    p = pins.withWatermark("pinned_at", delay)
    on = (c("entry_id") == c("pin_entry")) & (c("pinned_at") >= c("created_at")) & (c("pinned_at") <= c("created_at") + F.expr("interval 1 hour"))
    return e.join(p, on, "leftOuter")


def backfill(stream: DataFrame, stored: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], root: str, most: int) -> None:
    """Newest-first steps of at most ``most`` rows without a vector, until none is pending.

    The rows of a batch that ``stored`` (re-read for every batch) does not hold are put in order once and
    numbered, and the numbers deal them to steps, which are written together: the work grows with the
    rows, not with rows times steps. ``embed`` maps rows to rows and keeps their id; rows of one id stay in
    one step, rows without one have no vector. A batch that fails stops the stream before its offset is
    kept, and comes again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        folder, kept = f"{root}/vectors/batch={number}", f"{root}/order/batch={number}"
        pending = curation.pending_index(batch, stored())
        newest = pending.groupBy("id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("n")).orderBy(F.desc("created_at"), "id")
        newest.select("id", "created_at", "n", F.spark_partition_id().alias("part")).write.mode("overwrite").parquet(kept)
        order = batch.sparkSession.read.parquet(kept)
        inside = Window.partitionBy("part").orderBy(F.desc("created_at"), "id").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
        offsets = order.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        place = c("before") + F.sum("n").over(inside) - c("n")
        steps = order.join(offsets, "part").select("id", F.floor(place / most).cast("int").alias("step"))
        embed(pending).join(steps, "id").repartition("step").write.mode("overwrite").partitionBy("step").parquet(folder)

    run_batches(stream, handle, root)


def _keyed(stream: DataFrame, key: str, output: str, step: Callable, timeout_ms: int | None = None) -> DataFrame:
    """Keyed state machine: ``step(state dict, row) -> (state dict, output tuple | None)`` per row in
    (time, id) order of the batch. State is one JSON document per key, bounded by the caps of the
    step. A key's rows of one micro-batch arrive in Arrow chunks and are put in order together, so
    memory holds a key's share of a batch (bounded by the source's rate). A row that comes in a later
    batch than younger rows is applied when it comes."""

    def run(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        memory = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for row in pd.concat(list(frames)).sort_values(["time", "event_id"]).itertuples(index=False):
            memory, emitted = step(memory, row)
            if emitted is not None:
                rows.append((group[0], *emitted))
        state.update((json.dumps(memory),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in output.split(", ")])

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, output, "document string", "append", mode)


def claim_transitions(stream: DataFrame, prior: float, policy: dict = belief.POLICY) -> DataFrame:
    """Promotions and retractions as votes arrive: (claim, event_id, transition).

    ``stream``: claim, event_id, time, supported. A claim is promoted once it has the votes, mean and
    lower bound of the policy, and retracted when its mean or lower bound falls below what is kept."""

    def step(memory, row):
        good, bad = memory.get("good", 0) + bool(row.supported), memory.get("bad", 0) + (not row.supported)
        alpha, beta = 1 + 2 * prior + good, 1 + 2 * (1 - prior) + bad
        mean = alpha / (alpha + beta)
        lower = max(0.0, mean - 1.96 * (mean * (1 - mean) / (alpha + beta + 1)) ** 0.5)
        before = active = memory.get("active", False)
        if good + bad >= policy["votes"] and mean >= policy["mean"] and lower >= policy["lower"]:
            active = True
        elif mean < policy["keep_mean"] or lower < policy["keep_lower"]:
            active = False
        moved = None if active == before else (int(row.event_id), "promoted" if active else "retracted")
        return {"good": good, "bad": bad, "active": active}, moved

    return _keyed(stream, "claim", "claim bigint, event_id bigint, transition string", step)


def working_set(stream: DataFrame, most_items: int = 16, ttl_s: float = 86_400.0, idle_ms: int | None = None) -> DataFrame:
    """Session working set: re-observed items keep their best activation, expired ones leave, and the
    weakest is evicted beyond the cap. ``stream``: session, event_id, time, item, activation.

    ``idle_ms`` drops the state of idle sessions by processing time in a continuously running query;
    leave it unset for run-to-completion triggers, which a pending timer would keep alive."""

    def step(memory, row):
        items = {k: v for k, v in memory.items() if v[1] + ttl_s > row.time.timestamp()}
        key = str(row.item)
        added = key not in items
        first = row.time.timestamp() if added else items[key][1]
        strength = max(0.0, min(1.0, row.activation))
        items[key] = [strength if added else max(items[key][0], strength), first, row.time.timestamp()]
        evicted = ""
        if len(items) > most_items:
            evicted = min(items, key=lambda k: (items[k][0], items[k][2], k))
            del items[evicted]
        return items, (int(row.event_id), bool(added), evicted, len(items))

    return _keyed(stream, "session", "session bigint, event_id bigint, added boolean, evicted string, size int", step, timeout_ms=idle_ms)


def disclosure_fold(stream: DataFrame, turns: int = 10, most: int = 256) -> DataFrame:
    """Fold a record already shown with the same content at the same or a deeper level within
    ``turns`` turns. ``stream``: session, event_id, time, memory, content, depth."""

    def step(memory, row):
        turn = memory.get("turn", 0) + 1
        shown = {k: v for k, v in memory.get("shown", {}).items() if turn - v[2] < turns}
        key = str(row.memory)
        before = shown.get(key)
        folded = before is not None and before[0] == row.content and before[1] >= row.depth
        if not folded:
            shown.pop(key, None)
            shown[key] = [row.content, int(row.depth), turn]
            while len(shown) > most:
                shown.pop(next(iter(shown)))
        return {"turn": turn, "shown": shown}, (int(row.event_id), bool(folded))

    return _keyed(stream, "session", "session bigint, event_id bigint, folded boolean", step)


def phrase_pool(stream: DataFrame, capacity: int = 128, protected: int = 64) -> DataFrame:
    """Segmented LRU of recall phrases per session: two hits protect, the oldest unprotected leaves.
    ``stream``: session, event_id, time, phrase."""

    def step(memory, row):
        clock, pool = memory.get("clock", 0) + 1, memory.get("pool", {})
        hits = min(2, pool.get(row.phrase, [0])[0] + 1)
        pool[row.phrase] = [hits, clock, hits >= 2]
        shielded = sorted((v[1], k) for k, v in pool.items() if v[2])
        for _, name in shielded[: max(0, len(shielded) - protected)]:
            pool[name][2] = False
        retired = ""
        if len(pool) > capacity:
            retired = min((k for k, v in pool.items() if not v[2]), key=lambda k: pool[k][1])
            del pool[retired]
        return {"clock": clock, "pool": pool}, (int(row.event_id), hits, retired, len(pool))

    return _keyed(stream, "session", "session bigint, event_id bigint, hits int, retired string, size int", step)


def session_average(stream: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average of a vector per session. ``stream``: session, event_id, time, vector."""

    def step(memory, row):
        old = memory.get("h")
        new = [float(x) for x in row.vector]
        h = [alpha * a + (1 - alpha) * b for a, b in zip(new, old or [0.0] * len(new))]
        return {"h": h}, (int(row.event_id), float(sum(h)))

    return _keyed(stream, "session", "session bigint, event_id bigint, total double", step)
