"""Two-level inverted file for vectors: approximate neighbours, probing budgets and clustered leaves.

The number of leaves grows with the corpus (n / leaf rows), the number of coarse cells with its square
root. Centres are fitted on bounded samples: the coarse ones together, the leaves of each coarse cell
among that cell's own sample. Every row is placed by the coarse centres, which are few enough to travel
with each task, and then only by the leaves of its own cell; cells are cut by a salt, so a cell of any
size is many tasks. Rows are never paired with all leaves."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from keelson.operators import dense
from keelson.operators.lexical import top_k
from keelson.session import cut_lineage

c = F.col

COARSE_SAMPLE = 20_000  # rows that the coarse centres are fitted on, at most
LEAF_SAMPLE = 64  # rows a leaf that the leaves of a cell are fitted on, at most
SHARD_ROWS = 50_000  # rows of a cell that meet in one task
ROUNDS = 10  # of k-means


def unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def matrix_of(vectors) -> np.ndarray:
    return unit(np.vstack([np.asarray(v, float) for v in vectors]))


def spherical_kmeans(rows: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Centres of at most k clusters by cosine; far points are seeds, an empty cluster keeps its centre."""
    rows = unit(rows[np.lexsort(rows.T[::-1])])  # the order of arrival does not matter
    k = min(k, len(rows))
    start = int(np.random.default_rng(seed).integers(len(rows)))
    chosen, near = [start], rows @ rows[start]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        moved = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass(frozen=True)
class Cells:
    """``coarse``: centres that travel with tasks. ``leaves``: cell, leaf, centre. ``placed``: the corpus
    rows with cell, leaf and cosine to the leaf's centre."""

    coarse: np.ndarray
    leaves: DataFrame
    placed: DataFrame
    leaf_count: int


def with_cell(rows: DataFrame, vector: str, coarse: np.ndarray) -> DataFrame:
    """Adds the nearest coarse cell."""
    shared = rows.sparkSession.sparkContext.broadcast(coarse)  # square root of the number of leaves

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((matrix_of(vectors) @ shared.value.T).argmax(axis=1).astype(np.int32))

    return rows.withColumn("cell", nearest(c(vector)))


def salted(rows: DataFrame, by: str, seed: str = "id", shard: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows with a salt that cuts each group of ``by`` into parts of about ``shard`` rows, and (by, salts)."""
    parts = cut_lineage(rows.groupBy(by).agg(F.ceil(F.count("*") / shard).cast("int").alias("salts")))
    return rows.join(parts, by).withColumn("salt", F.pmod(F.xxhash64(seed), c("salts")).cast("int")).drop("salts"), parts


def on_every_salt(rows: DataFrame, by: str, parts: DataFrame) -> DataFrame:
    return rows.join(parts, by).withColumn("salt", F.explode(F.sequence(F.lit(0), c("salts") - 1))).drop("salts")


def build(corpus: DataFrame, leaf: int, seed: int = 7) -> Cells:
    """Cells over (id, embedding): about n / ``leaf`` leaves in about the square root of that many cells."""
    corpus = corpus.select("id", c("embedding").cast("array<double>").alias("embedding"))
    n = corpus.count()
    wanted = max(1, math.ceil(n / leaf))
    coarse_count = max(1, round(math.sqrt(wanted)))
    # a bounded sample in the order of a hash; the share keeps what meets in the sort small
    share = min(1.0, 2 * COARSE_SAMPLE / max(1, n))
    drawn = corpus.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(COARSE_SAMPLE)
    rows = [r["embedding"] for r in drawn.select("embedding").toLocalIterator()]
    if not rows:
        empty = corpus.withColumns({"cell": F.lit(0), "leaf": F.lit(0), "near": F.lit(0.0)})
        return Cells(np.zeros((0, 0)), corpus.sparkSession.createDataFrame([], "cell int, leaf int, centre array<double>"), empty, 0)
    coarse = spherical_kmeans(matrix_of(rows), coarse_count, seed)
    celled = cut_lineage(with_cell(corpus, "embedding", coarse))

    sizes = cut_lineage(celled.groupBy("cell").agg(F.ceil(F.count("*") / leaf).cast("int").alias("k"), F.count("*").alias("n")))
    chance = F.least(F.lit(1.0), 2 * LEAF_SAMPLE * c("k") / c("n"))
    sample = celled.join(F.broadcast(sizes), "cell").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= chance * (1 << 20))  # one row a cell

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        centres = spherical_kmeans(matrix_of(group["embedding"]), k, seed)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "leaf": np.arange(len(centres)), "centre": list(centres)})

    leaves = cut_lineage(sample.select("cell", "k", "embedding").groupBy("cell").applyInPandas(fit, "cell int, leaf int, centre array<double>"))
    return Cells(coarse, leaves, cut_lineage(place(celled, leaves)), leaves.count())


def place(celled: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows (id, embedding, cell) with the nearest leaf of their cell, and the next one."""
    rows, parts = salted(celled, "cell")

    def nearest(members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "embedding", "cell", "leaf", "near", "second", "second_near"]
        if members.empty or centres.empty:
            return pd.DataFrame({x: [] for x in columns})
        centres = centres.sort_values("leaf")
        scores = matrix_of(members["embedding"]) @ matrix_of(centres["centre"]).T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :2]
        at = np.arange(len(members))
        numbers = centres["leaf"].to_numpy()
        out = members[["id", "embedding", "cell"]].copy()
        out["leaf"], out["near"] = numbers[order[:, 0]], scores[at, order[:, 0]]
        two = order.shape[1] > 1
        out["second"] = numbers[order[:, 1]] if two else -1
        out["second_near"] = scores[at, order[:, 1]] if two else -1.0
        return out[columns]

    kind = celled.schema["id"].dataType.simpleString()
    met = rows.groupBy("cell", "salt").cogroup(on_every_salt(leaves, "cell", parts).groupBy("cell", "salt"))
    return met.applyInPandas(nearest, f"id {kind}, embedding array<double>, cell int, leaf int, near double, second int, second_near double")


def routes(cells: Cells, queries: DataFrame, coarse_probes: int, probes: int) -> DataFrame:
    """The nearest ``probes`` leaves of every query among those of its nearest coarse cells: query_id, embedding, cell, leaf, probe."""
    shared = queries.sparkSession.sparkContext.broadcast(cells.coarse)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        order = np.argsort(-(matrix_of(vectors) @ shared.value.T), axis=1, kind="stable")[:, :coarse_probes]
        return pd.Series(list(order.astype(np.int32)))

    asked = queries.select("query_id", c("embedding").cast("array<double>").alias("embedding"))
    sent = asked.select("query_id", "embedding", F.explode(nearest("embedding")).alias("cell"))
    rows, parts = salted(sent, "cell", "query_id")

    def best(members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if members.empty or centres.empty:
            return pd.DataFrame({"query_id": [], "cell": [], "leaf": [], "near": []})
        centres = centres.sort_values("leaf")
        scores = matrix_of(members["embedding"]) @ matrix_of(centres["centre"]).T
        keep = min(probes, scores.shape[1])
        order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
        return pd.DataFrame({
            "query_id": np.repeat(members["query_id"].to_numpy(), keep), "cell": members["cell"].iloc[0], "leaf": centres["leaf"].to_numpy()[order].ravel(),
            "near": np.take_along_axis(scores, order, axis=1).ravel(),
        })

    met = rows.groupBy("cell", "salt").cogroup(on_every_salt(cells.leaves, "cell", parts).groupBy("cell", "salt"))
    near = met.applyInPandas(best, "query_id bigint, cell int, leaf int, near double")
    picked = top_k(near.withColumn("code", c("cell").cast("bigint") * (1 << 31) + c("leaf")), "near", probes, tie="code", rank="probe").drop("code", "near")
    return picked.join(asked, "query_id")


def neighbours(cells: Cells, queries: DataFrame, k: int, coarse_probes: int, probes: int) -> DataFrame:
    """Approximate top k by cosine: (query_id, id, cosine, rank), exact inside the probed leaves."""
    code = c("cell").cast("bigint") * (1 << 31) + c("leaf")
    rows, parts = salted(cells.placed.select("id", "embedding", code.alias("code")), "code")
    asked = on_every_salt(routes(cells, queries, coarse_probes, probes).select("query_id", c("embedding").alias("query_vector"), code.alias("code")), "code", parts)

    def scan(members: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if members.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        q, i, s = dense._score_block(
            members["id"].to_numpy(), np.vstack(members["embedding"].to_list()).astype(float), wanted["query_id"].to_numpy(), dense._unit_rows(wanted["query_vector"].to_list()), k, 0.0
        )
        return pd.DataFrame({"query_id": q, "id": i, "cosine": s})

    met = rows.groupBy("code", "salt").cogroup(asked.groupBy("code", "salt")).applyInPandas(scan, "query_id bigint, id bigint, cosine double")
    return top_k(met, "cosine", k)


def region_leaves(vectors: DataFrame, region: str, leaf: int, tau: float, seed: int = 7) -> DataFrame:
    """Leaves of every region, ceil(n / leaf) of each, with boundary replicas: (id, region, cell, leaf, replica).

    A row joins its second leaf as well if that leaf's cosine reaches ``tau`` times its own leaf's. Regions
    are told apart by their number; a region's leaves are fitted on a bounded sample of it."""
    numbered = vectors.select(region).distinct().withColumn("cell", F.hash(region))
    rows = cut_lineage(vectors.select("id", c("embedding").cast("array<double>").alias("embedding"), region).join(numbered, region).select("id", "embedding", "cell", region))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / leaf).cast("int").alias("k"), F.count("*").alias("n"))
    chance = F.least(F.lit(1.0), 2 * LEAF_SAMPLE * c("k") / c("n"))
    sample = rows.join(sizes, "cell").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= chance * (1 << 20))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        centres = spherical_kmeans(matrix_of(group["embedding"]), int(group["k"].iloc[0]), seed)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "leaf": np.arange(len(centres)), "centre": list(centres)})

    leaves = cut_lineage(sample.select("cell", "k", "embedding").groupBy("cell").applyInPandas(fit, "cell int, leaf int, centre array<double>"))
    placed = cut_lineage(place(rows.select("id", "embedding", "cell"), leaves))
    extra = placed.where((c("second") >= 0) & (c("second_near") >= tau * c("near"))).select("id", "cell", c("second").alias("leaf"), F.lit(True).alias("replica"))
    return placed.select("id", "cell", "leaf", F.lit(False).alias("replica")).unionByName(extra).join(numbered, "cell").select("id", region, "leaf", "replica")
