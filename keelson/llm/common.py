"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from keelson.session import _checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"  # what separates words where the contract says [^\x20\x09-\x0D]+


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once into the shared checkpoint folder and read it back.

    Like a reliable checkpoint, later jobs re-read files after the loss of an executor; as Parquet
    they are compressed and columns are pruned."""
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts do not pile up in a worker (Spark bounds their
    bytes); a setting that somebody else has changed is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) in ("10000", *_SET):
        _SET.add(str(rows))
        spark.conf.set(key, str(rows))


_SET: set[str] = set()  # batch sizes that these operators have set


_CACHE: dict = {}


def worker_cache(tag: str, make: Callable):
    """What this Python worker keeps between batches and tasks of one call of an operator.

    There is one such value a worker: another call drops it, so a chain of operators in reused
    workers does not pile up caches."""
    if tag not in _CACHE:
        _CACHE.clear()
        _CACHE[tag] = make()
    return _CACHE[tag]


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that no column of the frame has."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_columns(
    df: DataFrame, inputs: list[Column], added: list[StructField], compute: Callable[[pa.RecordBatch], list], keep: list[str],
) -> DataFrame:
    """``keep`` columns of the frame plus the ``added`` ones, computed from ``inputs`` batch by batch.

    A kept column with the name of an added one gives way to it."""
    names = {x.name.lower() for x in added}
    keep = [x for x in keep if x.lower() not in names]
    fed = df.select(*[F.col(f"`{x}`") for x in keep], *[x.alias(f"__in{i}") for i, x in enumerate(inputs)])
    schema = StructType([*fed.schema.fields[: len(keep)], *added])
    kept, given, names = len(keep), [f"__in{i}" for i in range(len(inputs))], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(batch.select(given))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(kept)], *made], names=names)

    return fed.mapInArrow(run, schema)
