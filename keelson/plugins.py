"""Extension points: rankers, judges, embedders, models, summaries, SQL functions and table functions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from keelson.functions.windows import BOUNDARY

c = F.col
Q = "query_id"


def rank_with(page: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Add ``utility`` from an evidence ranker called on Arrow batches of (query, text) pairs.

    A ranker that fails or leaves [0, 1] anywhere in a query's page degrades that whole page to
    1 / rank; ``degraded`` says so. ``page``: query_id, id, query, text, rank.
    """

    @F.pandas_udf(T.DoubleType())
    def call(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.to_numeric(score(query, text), errors="coerce").astype("float64")
        except Exception:  # a broken ranker degrades, it does not fail the job
            return pd.Series([None] * len(query), dtype="float64")

    given = page.withColumn("_given", call(c("query"), c("text")))
    valid = F.coalesce(c("_given").between(0.0, 1.0) & ~F.isnan("_given"), F.lit(False))
    w = Window.partitionBy(Q)
    staged = given.withColumn("degraded", ~F.bool_and(valid).over(w))
    return staged.withColumn("utility", F.when(c("degraded"), 1 / c("rank")).otherwise(c("_given"))).drop("_given")


def judge_pairs(pairs: DataFrame, judge: Callable[[pd.DataFrame], list], labels: tuple[str, ...]) -> DataFrame:
    """Verdict of an external judge on candidate pairs only; anything outside ``labels`` is null."""
    schema = T.StructType(pairs.schema.fields + [T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = judge(batch)
            yield batch.assign(verdict=[v if v in labels else None for v in verdicts])

    return pairs.mapInPandas(run, schema)


def embed_with(rows: DataFrame, column: str, model: str, embed: Callable[[pd.Series], list]) -> DataFrame:
    """Vectors of a text column with the identity of the model that made them."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def call(text: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed(text)])

    return rows.withColumn("embedding", call(c(column))).withColumn("model", F.lit(model))


def guard_model(metadata: dict, embedder: str, domain: str) -> None:
    """Refuse a model trained for another embedder or another domain."""
    if metadata.get("embedder") not in (None, embedder):
        raise ValueError(f"model expects embedder {metadata['embedder']}, got {embedder}")
    if metadata.get("domains") and domain not in metadata["domains"]:
        raise ValueError(f"model does not accept domain {domain}")


def summarise_groups(rows: DataFrame, group: str, summary: Callable[[pd.Series], str]) -> DataFrame:
    """One summary per bounded leaf group through a grouped-aggregate function.

    Groups must be leaves (bounded by the leaf size), as the function sees a whole group.
    """

    @F.pandas_udf(T.StringType())
    def call(text: pd.Series) -> str:
        return summary(text)

    return rows.groupBy(group).agg(call(c("text")).alias("summary"))


def register_sql(spark: SparkSession) -> None:
    """SQL-callable cosine, built from native array expressions (no Python in the path)."""
    spark.sql(
        """create or replace temporary function memory_cosine(a array<double>, b array<double>) returns double return
        case when size(a) <> size(b) or aggregate(a, 0d, (s, x) -> s + x * x) = 0 or aggregate(b, 0d, (s, x) -> s + x * x) = 0 then 0d
        else greatest(-1d, least(1d, aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x)
          / (sqrt(aggregate(a, 0d, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0d, (s, x) -> s + x * x))))) end"""
    )


class PackEvidence:
    """Table function: the packing of one query's shortlist under given limits, called with PARTITION BY query_id.

    ``pack_evidence(table(items) partition by (query_id), most_items, most_characters)``; ids keep their types."""

    NEEDED = ("query_id", "id", "key", "chars", "utility", "position")

    def __init__(self):
        self.rows, self.limits = [], (0, 0)

    @staticmethod
    def analyze(row: AnalyzeArgument, most_items: AnalyzeArgument, most_characters: AnalyzeArgument) -> AnalyzeResult:
        fields = _table_fields(row, PackEvidence.NEEDED)
        for limit in (most_items, most_characters):
            if not isinstance(limit.value, int) or limit.value < 1:
                raise ValueError("limits are constant positive integers")
        return AnalyzeResult(T.StructType([fields["query_id"], fields["id"], T.StructField("characters", T.IntegerType()), T.StructField("slot", T.IntegerType())]))

    def eval(self, row, most_items: int, most_characters: int):
        self.limits = most_items, most_characters
        self.rows.append(tuple(row[x] for x in self.NEEDED))

    def terminate(self):
        from keelson.operators.budget import _pack

        picked, used = _pack(pd.DataFrame(self.rows, columns=list(self.NEEDED)), *self.limits)
        for slot, record in enumerate(picked.itertuples(index=False), start=1):
            yield record.query_id, record.id, int(used), slot


def _table_fields(row: AnalyzeArgument, needed: tuple[str, ...]) -> dict[str, T.StructField]:
    """The fields of a table argument by name; a missing one is named."""
    if not row.isTable:
        raise ValueError("the first argument is a table")
    fields = {x.name: x for x in row.dataType.fields}
    if missing := [x for x in needed if x not in fields]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return fields


class QueryWindows:
    """Table function: windows of every text of a table, ``query_windows(table(texts) partition by (id), window, most, snap)``.

    Returns the key column as it is named and typed, the window's place and its text; the windows are those of
    ``functions.windows.query_windows``."""

    @staticmethod
    def analyze(row: AnalyzeArgument, window: AnalyzeArgument, most: AnalyzeArgument, snap: AnalyzeArgument) -> AnalyzeResult:
        fields = _table_fields(row, ("id", "text"))
        if not all(isinstance(x.value, int) for x in (window, most, snap)) or window.value < 1:
            raise ValueError("window, most and snap are constant integers, the window at least one")
        return AnalyzeResult(T.StructType([fields["id"], T.StructField("pos", T.LongType()), T.StructField("piece", T.StringType())]))

    def eval(self, row, window: int, most: int, snap: int):
        for pos, piece in enumerate(windows_of(row["text"], window, most, snap)):
            yield row["id"], pos, piece


def windows_of(text: str | None, window: int, most: int, snap: int) -> list[str]:
    """Equal segments, cut behind the first boundary within ``snap`` characters, if the windows cover the text;
    else full windows, the first and last pinned to its ends."""
    if text is None:
        return []
    size = len(text)
    if size <= window:
        return [text]
    count = min(-(-size // window), max(2, most))
    nearest = lambda x: math.floor(x + 0.5)
    if size > count * window:
        stride = (size - count * window) / (count - 1) + window
        starts = [0, *(nearest(i * stride) for i in range(1, count - 1)), size - window]
        return [text[x : x + window] for x in starts]
    cuts = [0]
    for i in range(1, count):
        ideal = nearest(i * size / count)
        ceiling = min(size - 1, ideal + snap)
        found = _BOUNDARY.search(text, ideal, min(size, ceiling + 2))
        cuts.append(found.start() + 1 if found and found.start() <= ceiling else min(ideal, ceiling))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], size], strict=True) if a < b]


_BOUNDARY = re.compile(BOUNDARY)


class SearchTerms:
    """Table function: distinct search terms of one text."""

    def eval(self, text: str):
        import regex

        from keelson.functions.text import SEARCH_STOP_WORDS

        seen = set()
        for token in regex.findall(r"[\p{L}\p{N}_+.#-]+", text.strip().lower()):
            grams = [token] if len(token) >= 2 and token not in SEARCH_STOP_WORDS else []
            if regex.search(r"\p{Han}", token) and len(token) > 4:
                grams += [token[i : i + 2] for i in range(len(token) - 1)]
            for gram in grams:
                if gram not in seen:
                    seen.add(gram)
                    yield (gram,)


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("pack_evidence", F.udtf(PackEvidence))
    spark.udtf.register("query_windows", F.udtf(QueryWindows))
    spark.udtf.register("search_terms", F.udtf(SearchTerms, returnType="term string"))
