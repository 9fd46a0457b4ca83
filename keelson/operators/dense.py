"""Vector candidate joins and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx, vectors as vx
from keelson.session import spread


def hashed_vectors(texts: DataFrame, key: str, column: str, dimensions: int = 256) -> DataFrame:
    """Signed feature hashing of tokens and their 3-grams (Han: pairs), one vector a text: (key, embedding).

    A text is hashed in the row it stands in: no token and no feature becomes a row, nothing is shuffled.
    Texts whose features are none or cancel out are left out; texts with one key count as one.
    """
    if texts.groupBy(key).count().where("count > 1").limit(1).count():
        texts = texts.groupBy(key).agg(F.array_join(F.collect_list(column), "\n").alias(column))
    low = F.lower(tx.strip(F.col(column)))
    rows = spread(texts).select(F.col(key), tx.matches(low, r"[\p{L}\p{N}_+.#-]+").alias("tokens"), tx.may_hold_han(F.col(column)).alias("any_han"))
    han = F.when(F.col("any_han"), F.array_distinct(F.filter("tokens", lambda t: t.rlike(r"\p{IsHan}"))))
    rows = rows.select(key, "tokens", han.alias("han"))

    def hash_batches(batches):
        import pyarrow as pa

        for batch in batches:
            sums = vx.hashed_sums(batch.column(1), batch.column(2), dimensions)
            used = sums.any(axis=1)
            flat = pa.array(sums[used].ravel())
            offsets = pa.array(range(0, len(flat) + 1, dimensions), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(used)), pa.ListArray.from_arrays(offsets, flat)], [key, "embedding"])

    return rows.mapInArrow(hash_batches, f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<int>")


def hashed_dimensions(texts: DataFrame, key: str, column: str, dimensions: int = 256) -> DataFrame:
    """``hashed_vectors`` with one row per used dimension: (key, bucket, v)."""
    rows = hashed_vectors(texts, key, column, dimensions).select(key, F.posexplode("embedding").alias("bucket", "v"))
    return rows.where("v <> 0").select(key, F.col("bucket").cast("bigint").alias("bucket"), F.col("v").cast("bigint").alias("v"))


BLOCK_QUERIES = 2_048  # queries scored at a time, if the shard leaves room for so many
GROUP_QUERIES = 8_192  # queries that meet a shard in one task, in blocks
SHARD_ROWS = 10_000
CELLS = 1_000_000  # scores held at a time: 8 MB


def _score_block(ids, matrix, query_ids, queries, k: int, minimum: float):
    """Best ``k`` corpus rows per query of one block, as column arrays, in slices of queries of bounded area.

    Scores are rounded before the cut, which is in the final order (score, then id) and therefore does not depend
    on shards. Score and place by id make one number, so rows of equal score are cut like any others: a slice
    holds its scores once and returns ``k`` rows a query, however many rows tie. A score that is no number counts as -1."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    norms = np.linalg.norm(matrix, axis=1)
    norms[norms == 0] = 1.0
    count, keep = len(ids), min(k, len(ids))
    place, out = np.arange(count - 1, -1, -1, dtype="float64"), []
    high = max(1, CELLS // count)
    for low in range(0, len(queries), high):
        keys = queries[low : low + high] @ matrix.T
        keys /= norms
        np.fmin(np.fmax(keys, -1.0, out=keys), 1.0, out=keys)
        keys *= 1e6
        np.rint(keys, out=keys)
        keys *= count  # whole numbers far below 2**53 stay exact
        keys += place
        keys.partition(count - keep, axis=1)
        score, back = np.divmod(keys[:, count - keep :], count)
        score /= 1e6
        rows, cols = np.nonzero(score > minimum)
        out.append((query_ids[low + rows], ids[count - 1 - back[rows, cols].astype("int64")], score[rows, cols]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _unit_rows(values):
    import numpy as np

    matrix = np.vstack(values).astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def _matrix(vectors):
    """An Arrow column of lists as a float64 matrix; lists of several lengths are refused."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(vectors).unique().to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)[:5]}")
    return pc.list_flatten(vectors).to_numpy().reshape(len(vectors), sizes[0]).astype("float64")


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 20, minimum: float = 0.0, limit: int = BLOCK_QUERIES) -> DataFrame:
    """Exact cosine candidates: (query_id, id, cosine, rank), cosine above ``minimum``.

    ``corpus``: id, embedding. ``queries``: query_id, embedding. Bounded groups of queries meet bounded
    corpus shards in a co-group, whatever the sizes, so neither side is ever whole in one task or in the
    driver. A cell scores at most ``limit`` queries at a time and returns its own top-k; the corpus is sent
    once for each group, not for each of its blocks.
    """
    schema = "query_id bigint, id bigint, cosine double"
    blocks = max(1, -(-queries.count() // max(limit, GROUP_QUERIES)))
    shards = max(1, -(-corpus.count() // SHARD_ROWS), min(8, corpus.sparkSession.sparkContext.defaultParallelism))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    # New names keep the two sides apart even when both come from one table.
    left = corpus.where("embedding is not null").select(
        "id", F.col("embedding").alias("row_vector"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each_block.alias("block")
    )
    right = queries.where("embedding is not null").select(
        "query_id", F.col("embedding").alias("query_vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each_shard.alias("shard")
    )

    def cell(rows, asked):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        ids, matrix = rows["id"].to_numpy().astype("int64"), _matrix(rows["row_vector"])
        numbers, vectors = asked["query_id"].to_numpy().astype("int64"), _unit_rows(_matrix(asked["query_vector"]))
        found = [_score_block(ids, matrix, numbers[n : n + limit], vectors[n : n + limit], k, minimum) for n in range(0, len(numbers), limit)]
        return pa.table(dict(zip(("query_id", "id", "cosine"), (np.concatenate(x) for x in zip(*found)))))

    from keelson.operators.lexical import top_k

    partial = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, schema)
    return top_k(partial, "cosine", k)


def pair_cosines(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of given (query_id, id) pairs only: the cross-score of candidates found elsewhere."""
    joined = pairs.join(corpus.select("id", F.col("embedding").alias("_c")), "id").join(
        queries.select("query_id", F.col("embedding").alias("_q")), "query_id"
    )
    value = vx.cosine(vx.as_double(F.col("_q")), vx.as_double(F.col("_c")))
    return joined.withColumn("cosine", F.round(value, 6)).drop("_c", "_q")


def mention_scores(pages: DataFrame, radius: int = 240) -> DataFrame:
    """Cosine of every mention's context with the page's first mention: (page, mention, score).

    ``pages``: page, body, name. Contexts are cut around each occurrence with the mention masked,
    embedded by feature hashing, and met in an equi-join on (page, dimension).
    """
    c = F.col
    parts = pages.withColumn("parts", F.split("body", F.regexp_replace("name", r"(\W)", r"\\$1"))).where(F.size("parts") >= 3)
    cut = lambda i: F.concat(
        F.substr(F.get("parts", i - 1), F.greatest(F.lit(1), F.length(F.get("parts", i - 1)) - radius + 1), F.lit(radius)), F.lit(" [MENTION] "),
        F.substr(F.get("parts", i), F.lit(1), F.lit(radius)),
    )
    contexts = parts.select("page", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), cut)).alias("mention", "text"))
    keyed = contexts.withColumn("key", F.concat_ws("/", "page", "mention"))
    dims = hashed_dimensions(keyed.select("key", "text"), "key", "text").withColumn("page", F.split("key", "/")[0].cast("bigint")).withColumn("mention", F.split("key", "/")[1].cast("int"))
    size = dims.groupBy("page", "mention").agg(F.sqrt(F.sum(c("v") * c("v"))).alias("size"))
    anchor = dims.where("mention = 0").select("page", "bucket", c("v").alias("av"))
    dots = dims.where("mention > 0").join(anchor, ["page", "bucket"]).groupBy("page", "mention").agg(F.sum(c("v") * c("av")).alias("dot"))
    base = size.where("mention = 0").select("page", c("size").alias("asize"))
    return size.where("mention > 0").join(base, "page").join(dots, ["page", "mention"], "left").select(
        "page", "mention", F.round(F.coalesce("dot", F.lit(0)) / (c("size") * c("asize")), 6).alias("score")
    )
