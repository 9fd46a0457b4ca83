"""Lexical retrieval: BM25 candidate join, exact anchors, trigger phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx
from keelson.session import explode_rows, small_side, spread

K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def exact_anchor_hits(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Records holding a literal anchor on token edges.

    A query is a literal lookup when its only content is one anchor. Candidates come from an
    equi-join on the anchor's first index token; the edge condition is then verified on the text.
    """
    anchors = queries.select("query_id", tx.surface_anchors(F.col("query"))[0].alias("anchor"), tx.match_form(F.col("query")).alias("nq"))
    literal = F.btrim("nq", F.lit("`\"'“”‘’"))
    wanted = anchors.where((F.col("anchor") == literal) & F.col("anchor").rlike(r"\p{L}"))
    token = lambda c: tx.matches(c, r"[\p{L}\p{N}]+")
    keyed = wanted.withColumn("token", token(F.col("anchor"))[0])
    normal = texts.select("id", tx.match_form(F.col("statement")).alias("nt"))
    # ids and tokens meet first; the text follows only to the records that hold an anchor's token
    tokens = explode_rows(normal, F.array_distinct(token(F.col("nt"))), "token", "id")
    candidates = tokens.join(keyed, "token").join(normal, "id")
    word = r"[\p{L}\p{M}\p{N}_./\\:@+#-]"
    # Every other occurrence is padded so the edge test needs no per-row lookbehind pattern.
    escaped = F.regexp_replace("anchor", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit(f"(?<!{word})"), escaped, F.lit(f"(?!{word})"))
    return candidates.where(F.regexp_like("nt", pattern)).select("query_id", "id", "anchor")


FEW_ANCHORS = 5_000


def surface_hits(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Records that contain a query's surface anchor anywhere, punctuation included: (query_id, id, anchor).

    Few anchors of three characters or more are looked for in every text as it is read: nothing of a text
    is shuffled. Many ones meet records on their first trigram; the whole anchor is then looked for in the
    texts that hold it."""
    anchors = queries.select("query_id", F.explode(tx.surface_anchors(F.col("query"))).alias("anchor")).where("length(anchor) >= 3").distinct()
    normal = texts.select("id", F.regexp_replace(tx.match_form(F.col("statement")), r"\s+", " ").alias("nt"))
    if anchors.limit(FEW_ANCHORS + 1).count() <= FEW_ANCHORS:
        return normal.join(F.broadcast(anchors), F.col("nt").contains(F.col("anchor"))).select("query_id", "id", "anchor")
    keyed = anchors.withColumn("gram", F.substring("anchor", 1, 3))
    grams = explode_rows(normal, F.array_distinct(tx.char_ngrams(F.col("nt"), 3)), "gram", "id")
    candidates = grams.join(keyed, "gram").select("query_id", "id", "anchor")
    return candidates.join(normal, "id").where(F.col("nt").contains(F.col("anchor"))).select("query_id", "id", "anchor")


def trigger_matches(queries: DataFrame, profile: DataFrame) -> DataFrame:
    """Longest trigger of every record found in every query, on word edges; Han triggers anywhere.

    Both sides meet on the trigger text: queries contribute their word n-grams, and for Han triggers
    their runs of characters, of just the lengths that triggers have, so no query is ever compared
    with every trigger.
    """
    phrases = profile.select("id", F.explode("triggers").alias("raw")).select("id", tx.statement_form(F.col("raw")).alias("phrase"))
    phrases = phrases.where("length(phrase) >= 2").distinct()
    han = F.col("phrase").rlike(r"\p{IsHan}")
    lengths = phrases.agg(
        F.collect_set(F.when(~han, F.size(F.split("phrase", " ")))).alias("word_sizes"), F.collect_set(F.when(han, F.length("phrase"))).alias("han_sizes"),
    )  # one row: the few lengths that occur
    words = F.split("nq", " ")
    fit = lambda sizes, n: F.filter(sizes, lambda x: x <= n)
    grams = F.flatten(
        F.transform(
            fit(F.col("word_sizes"), F.size(words)),
            lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
        )
    )
    runs = F.flatten(
        F.transform(
            fit(F.col("han_sizes"), F.length("nq")),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("nq") - n + 1), lambda i: F.substring(F.col("nq"), i, n)),
        )
    )
    exploded = queries.crossJoin(F.broadcast(lengths)).select("query_id", F.explode(F.array_distinct(F.concat(grams, runs))).alias("phrase"))
    return exploded.join(phrases, "phrase").groupBy("query_id", "id").agg(F.max(F.length("phrase")).cast("bigint").alias("score"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term) rows of a query table."""
    terms = tx.query_index_terms(tx.match_form(F.col("query")))
    return queries.select("query_id", F.explode(terms).alias("term"))


EVERY = ""  # term that every record has once; no token is empty


def postings(records: DataFrame) -> DataFrame:
    """(id, dl, term, tf) rows, with one of the term ``EVERY`` for each record.

    Every token of a record leaves one row of one task, so the map-side aggregation is already
    complete and the exchange carries one row per distinct (record, term).
    """
    tokens = records.select("id", tx.index_terms(F.col("text")).alias("tokens"))
    # The length is its own column before the explode, so exploded rows do not carry the array.
    sized = tokens.withColumn("dl", F.size("tokens"))
    marked = F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.lit(EVERY)))
    exploded = explode_rows(sized, marked, "term", "id", "dl")
    return exploded.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_hits(asked: DataFrame, records: DataFrame) -> DataFrame:
    """Postings of the terms of ``asked`` and of ``EVERY``.

    The record side is cut to the query vocabulary before anything is shuffled."""
    terms = asked.select("term").distinct()
    wanted = terms.unionByName(terms.sparkSession.range(1).select(F.lit(EVERY).alias("term")))
    return postings(spread(records.select("id", "text"))).join(small_side(wanted), "term", "left_semi")


def bm25_weights(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, term, idf, avgdl) of the query terms that occur. Texts are read once: the number of records and their
    mean length come from the hits too."""
    # Reading ``tf`` and filtering nothing keep all uses of the postings identical, so their exchange is reused.
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    each = F.when(F.col("term") == EVERY, F.col("tf"))
    sized = F.when(F.col("dl").isNotNull(), each)
    stats = hits.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("dl") * each), F.sum(sized)).alias("avgdl"))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return asked.join(df, "term").crossJoin(stats).select("query_id", "term", idf.alias("idf"), "avgdl")  # one stats row


def bm25_sums(joined: DataFrame) -> DataFrame:
    """(query_id, id, bm25) of postings that met their weighted query terms."""
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * saturated), 6).alias("bm25"))


def bm25_scores(queries: DataFrame, records: DataFrame) -> DataFrame:
    """OR-query BM25 of every (query, record) sharing a term: (query_id, id, bm25).

    Postings meet the weighted query terms map-side while the query set is small (counted); a larger
    one falls back to a shuffled join. Contributions combine map-side per (query, record).
    """
    asked = query_terms(queries)
    hits = bm25_hits(asked, records)
    return bm25_sums(hits.join(small_side(asked, bm25_weights(asked, hits)), "term"))


def top_k(scored: DataFrame, score: str, k: int, key: str = "query_id", tie: str = "id", rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key, score descending then id.

    The rank filter lets Catalyst keep only ``k`` rows per key in every map task before the
    exchange (window group limit), so one hot query cannot flood a reducer.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25_top_k(queries: DataFrame, records: DataFrame, k: int = 20, allowed: Column | None = None) -> DataFrame:
    """Lexical candidates; ``allowed`` filters records before the limit is applied."""
    visible = records if allowed is None else records.where(allowed)
    return top_k(bm25_scores(queries, visible), "bm25", k)


def feedback_queries(queries: DataFrame, hits: DataFrame, records: DataFrame, terms: int, shortest: int) -> DataFrame:
    """Second query per query: the most frequent long words of its first hits that it lacks."""
    page = hits.select("query_id", "id").join(records, "id")
    words = page.select("query_id", F.explode(tx.index_terms(F.col("text"))).alias("w")).where(F.length("w") >= shortest)
    own = query_terms(queries).withColumnRenamed("term", "w")
    counts = words.join(own, ["query_id", "w"], "left_anti").groupBy("query_id", "w").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "w")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= terms)
    return kept.groupBy("query_id").agg(F.array_join(F.collect_list("w"), " ").alias("query"))
