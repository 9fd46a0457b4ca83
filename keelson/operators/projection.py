"""Presentation columns: previews, evidence lines, flattened parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WITHDRAWN = "[forget] (content withdrawn)"


def preview(statement: Column, forgotten: Column, limit: int = 320) -> Column:
    """White space collapsed, cut with an ellipsis, masked when withdrawn."""
    flat = F.trim(F.regexp_replace(statement, r"\s+", " "))
    cut = F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
    return F.when(forgotten, WITHDRAWN).otherwise(cut)


def flatten_parts(df: DataFrame, column: str) -> DataFrame:
    """Ordered text/image parts to one text view and one hash per image."""
    parts = F.from_json(column, "array<struct<type:string,text:string,url:string>>")
    staged = df.withColumn("_parts", parts)
    texts = F.transform(F.filter("_parts", lambda p: p["type"] == "text"), lambda p: p["text"])
    images = F.transform(F.filter("_parts", lambda p: p["type"] == "image_url"), lambda p: F.sha2(p["url"], 256))
    return staged.withColumn("text_view", F.array_join(texts, "\n")).withColumn("image_hashes", images).drop("_parts")


def evidence_line(page: DataFrame, partition: str, source_chars: int = 240) -> DataFrame:
    """Rendered evidence record per row; a scope shared by the whole page is lifted out.

    ``page``: id, node, memory_type, truth_status, scope, resolution, external, forgotten,
    statement, source plus the partition (page) key. Pages are bounded by their limit.
    """
    w = Window.partitionBy(partition)
    uniform = (F.count("*").over(w) >= 2) & (F.min("scope").over(w) == F.max("scope").over(w)) & (F.col("scope") != "{}")
    staged = page.withColumn("page_scope", F.when(uniform, F.col("scope")))
    flags = F.concat_ws(
        " ",
        F.when(F.col("external"), F.concat(F.lit("[external, "), "truth_status", F.lit("]"))),
        F.when(F.col("resolution").isin("open", "reopened"), "[open]"),
    )
    details = F.concat_ws(
        "; ",
        F.concat(F.lit("memory="), F.col("id").cast("string")),
        F.concat(F.lit("node="), F.col("node").cast("string")),
        F.when(~F.col("memory_type").isin("fact", "conversation_evidence"), F.concat(F.lit("type="), "memory_type")),
        F.when(~F.col("external") & (F.col("truth_status") != "asserted"), F.concat(F.lit("truth="), "truth_status")),
        F.when(F.col("page_scope").isNull() & (F.col("scope") != "{}"), F.concat(F.lit("scope="), "scope")),
    )
    flat = F.trim(F.regexp_replace("source", r"\s+", " "))
    excerpt = F.when(F.length(flat) <= source_chars, flat).otherwise(F.concat(F.substring(flat, 1, source_chars - 1), F.lit("…")))
    source_line = F.when(
        F.col("forgotten") | (F.trim("source") == F.trim("statement")), ""
    ).otherwise(F.concat(F.lit("\n  SOURCE="), excerpt))
    body = F.when(F.col("forgotten"), WITHDRAWN).otherwise(F.col("statement"))
    line = F.concat(F.when(flags != "", F.concat(F.lit("- "), flags, F.lit(" "))).otherwise("- "), body, F.lit("\n  "), details, source_line)
    return staged.withColumn("line", line)
