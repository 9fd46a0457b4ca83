"""Writers and write-set preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def request_hash(*columns: str) -> Column:
    """Canonical hash of a request: nulls dropped, keys sorted by name."""
    ordered = [F.col(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def plan_upsert(existing: DataFrame, batch: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent keyed merge.

    ``batch``: key, operation_id, request_hash, slot, payload. ``receipts``: operation_id,
    request_hash. A known operation with the same hash is a replay and changes nothing; with
    another hash it is a conflict and is reported. The rest merges last-write-wins by slot and
    raises the revision of the key by one. Returns (merged table, conflicts).
    """
    known = batch.join(receipts.withColumnRenamed("request_hash", "receipt_hash"), "operation_id", "left")
    conflicts = known.where("receipt_hash is not null and receipt_hash <> request_hash").drop("receipt_hash")
    fresh = known.where("receipt_hash is null")
    last = fresh.groupBy("key").agg(F.max_by("payload", "slot").alias("new_payload"))
    merged = existing.join(last, "key", "full_outer").select(
        "key",
        F.coalesce("new_payload", "payload").alias("payload"),
        (F.coalesce("revision", F.lit(0)) + F.when(F.col("new_payload").isNotNull(), 1).otherwise(0)).alias("revision"),
    )
    return merged, conflicts


def write_upsert(merged: DataFrame, path: str, partition: str | None = None) -> None:
    """Full rewrite of the affected table version; readers switch by path."""
    writer = merged.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def apply_upsert(spark: SparkSession, root: str, batch: DataFrame) -> DataFrame:
    """One idempotent upsert on a stored table: writes the next version and its receipts, returns conflicts.

    Versions are folders ``v0``, ``v1``, ...; a version's receipts are all operations applied so far. A
    version counts once its receipts are complete, so a run that fails midway is simply run again."""
    version = current_version(spark, root)
    table, receipts = read_version(spark, root, version)
    merged, conflicts = plan_upsert(table, batch, receipts)
    done = batch.select("operation_id", "request_hash").distinct().join(receipts, "operation_id", "left_anti")
    write_upsert(merged, f"{root}/v{version + 1}/table")
    receipts.unionByName(done).write.mode("overwrite").parquet(f"{root}/v{version + 1}/receipts")
    return conflicts


def current_version(spark: SparkSession, root: str) -> int:
    """The highest version with complete receipts; -1 where nothing was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "v*/receipts/_SUCCESS")) or []
    return max([int(x.getPath().getParent().getParent().getName()[1:]) for x in done], default=-1)


def read_version(spark: SparkSession, root: str, version: int, payload: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(table, receipts) of a version; empty ones before the first."""
    shapes = f"key bigint, payload {payload}, revision bigint", "operation_id bigint, request_hash string"
    if version < 0:
        return tuple(spark.createDataFrame([], x) for x in shapes)
    return tuple(spark.read.schema(x).parquet(f"{root}/v{version}/{name}") for x, name in zip(shapes, ("table", "receipts"), strict=True))


def split_writes(classified: DataFrame) -> dict[str, DataFrame]:
    """Accepted rows, rejected rows with their reason, and one audit row for every input."""
    return {
        "accepted": classified.where("reason = 'allowed'").drop("reason"),
        "rejected": classified.where("reason <> 'allowed'"),
        "audit": classified.select(
            "id", F.when(F.col("reason") == "allowed", "accepted").otherwise("rejected").alias("decision"), "reason"
        ),
    }


def write_split(classified: DataFrame, root: str) -> None:
    for name, frame in split_writes(classified).items():
        frame.write.mode("overwrite").parquet(f"{root}/{name}")


def hash_split(key: Column) -> Column:
    """Stable 60/20/20 split from the first 32 bits of SHA-256."""
    bucket = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(bucket < 6, "train").when(bucket < 8, "validation").otherwise("test")


def write_policy_dataset(rows: DataFrame, path: str) -> None:
    """De-identified dataset partitioned by split; text columns never reach it."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def export_bundle(memories: DataFrame, nodes: DataFrame, evidence: DataFrame, actor: str | None, deleted: bool) -> DataFrame:
    """Records with node and evidence in source order, sorted by (created_at, id).

    Evidence lists are per record, so the regrouping is bounded by one record's own list.
    """
    kept = memories if deleted else memories.where("status <> 'deleted'")
    if actor is not None:
        kept = kept.where(F.col("source_actor") == actor)
    exploded = kept.select("id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    listed = (
        exploded.join(evidence, "evidence_id")
        .groupBy("id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]).alias("evidence"))
    )
    return kept.join(nodes, "node").join(listed, "id", "left").orderBy("created_at", "id")
