"""Plug-in surface over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson import plugins as pg
from keelson.operators import learning as ml
from keelson.plans import bindings as b
from keelson.plans.fusion import TEXT_CANDIDATES, shortlist, text_candidates
from keelson.plans.graph import MODEL_COLUMNS, labelled
from keelson.registry import REGISTRY, query

c = F.col


@query("p1_evidence_ranker", b.cte(b.RECORDS, b.QUERIES, TEXT_CANDIDATES, "s as (select *, case when query_id % 4 = 1 then length(text) / 100.0 else 1 / (1 + length(text) / 1000.0) end as given from tc), d as (select query_id, bool_or(given > 1) as bad from s group by 1)") + """
select query_id, id, bad as degraded, round(case when bad then 1.0 / position else given end, 6)::double as utility from s join d using (query_id)""")
def p1(t):
    """A length-based ranker; on every fourth query it leaves the allowed range."""
    rows = text_candidates(t).select("query_id", "id", F.col("query_id").cast("string").alias("query"), "text", c("position").alias("rank"))

    def score(q, text):
        n = text.str.len()
        odd = q.astype("int64") % 4 == 1
        return (n / 100).where(odd, 1 / (1 + n / 1000))

    return pg.rank_with(rows, score).select("query_id", "id", "degraded", F.round("utility", 6).alias("utility"))


@query("p2_pair_judge", """
select doc_id as id, case when doc_id % 3 = 0 then 'same' when doc_id % 3 = 1 then 'other' end as verdict from documents""")
def p2(t):
    pairs = t.documents.select(c("doc_id").alias("id"))
    verdicts = ("same", "other", "unparsable reply")
    return pg.judge_pairs(pairs, lambda frame: [verdicts[i % 3] for i in frame["id"]], ("same", "other"))


@query("p3_embedder", "select doc_id as id, 'char-counts@1' as model, 3::bigint as dimensions, round(length(text) / 1000.0, 4)::double as first from documents")
def p3(t):
    rows = b.records(t).select("id", c("statement").alias("text"))
    out = pg.embed_with(rows, "text", "char-counts@1", lambda s: [(len(x) / 1000, x.count(" "), 1.0) for x in s])
    return out.select("id", "model", F.size("embedding").cast("bigint").alias("dimensions"), F.round(c("embedding")[0].cast("double"), 4).alias("first"))


@query("p4_guarded_model")
def p4(t):
    rows = labelled(t)
    model = ml.train_scorer(rows, "label", MODEL_COLUMNS)
    pg.guard_model({"embedder": "fixture-64", "domains": ["notes"]}, "fixture-64", "notes")
    return ml.score_rows(model, rows).select("query_id", "id", F.round("model_score", 6).alias("model_score"))


@query("p5_leaf_summary", "select source || ':' || doc_id // 200 as leaf, min(length(text)) || '-' || max(length(text)) as summary from documents group by 1")
def p5(t):
    rows = t.documents.select(F.concat_ws(":", "source", F.floor(c("doc_id") / 200)).alias("leaf"), "text")
    return pg.summarise_groups(rows, "leaf", lambda s: f"{s.str.len().min()}-{s.str.len().max()}").select("leaf", "summary")


@query("p6_sql_cosine", """
select a.vec_id as id, round(list_dot_product(a.embedding::double[], z.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(z.embedding::double[], z.embedding::double[]))), 6) as cosine
from embeddings a join embeddings z on z.vec_id = a.vec_id + 1""")
def p6(t):
    pg.register_sql(t.spark)
    e = t.embeddings.select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("a"))
    j = e.join(e.select((c("id") - 1).alias("id"), c("a").alias("b")), "id")
    return j.select("id", F.round(F.expr("memory_cosine(a, b)"), 6).alias("cosine"))


@query("p7_table_functions", b.cte(f"q as (select item_id, {b.sql_search_terms('text')} as terms from benchmark)") + "select item_id as query_id, len(terms)::bigint as terms, md5(array_to_string(list_sort(terms), ' ')) as term_key from q")
def p7(t):
    pg.register_table_functions(t.spark)
    t.benchmark.createOrReplaceTempView("keelson_query_log")
    rows = t.spark.sql("select q.item_id as query_id, s.term from keelson_query_log q, lateral search_terms(q.text) s")
    return rows.groupBy("query_id").agg(F.count("*").alias("terms"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")).alias("term_key"))


@query("p7_pack_function")
def p7_pack(t):
    pg.register_table_functions(t.spark)
    items = shortlist(t).select("query_id", "id", (c("id") % 23).cast("string").alias("key"), "chars", F.least(c("score"), F.lit(1.0)).alias("utility"), "position")
    items.createOrReplaceTempView("keelson_pack_items")
    return t.spark.sql("select * from pack_evidence(table(keelson_pack_items) partition by (query_id), 20, 2500)")


@query("p7_query_windows", REGISTRY["x12_query_windows"].sql)
def p7_windows(t):
    """The windows of X12 from SQL, the limits as arguments."""
    pg.register_table_functions(t.spark)
    t.documents.select(c("doc_id").alias("id"), "text").createOrReplaceTempView("keelson_texts")
    return t.spark.sql("select id, pos, md5(piece) as digest from query_windows(table(keelson_texts) partition by (id), 2000, 10, 400)")
