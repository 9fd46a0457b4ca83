"""Candidate joins, fusion and the retrieval pipeline over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.functions import text as tx
from keelson.operators import dense, evaluation as ev, fuse, lexical
from keelson.plans import bindings as b
from keelson.registry import query

BM25 = f"""qt as (select distinct query_id, u.t as term from queries, unnest({b.sql_search_terms('query')}) as s(w), unnest(regexp_extract_all(strip_accents(s.w), '[\\p{{L}}\\p{{N}}]+')) as u(t)),
tk as (select id, u.t as term from records, unnest({b.sql_index_tokens('statement')}) as u(t)),
tf as (select id, term, count(*) as tf from tk group by 1, 2),
dl as (select id, len({b.sql_index_tokens('statement')}) as dl from records),
st as (select count(*) as n, avg(dl) as avgdl from dl),
dfs as (select term, count(*) as df from tf group by 1),
bm as (select query_id, tf.id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as bm25
  from qt join tf using (term) join dfs using (term) join dl on dl.id = tf.id, st group by 1, 2)"""


def bm_top(k: int) -> str:
    return f"""top as (select * from (select *, row_number() over (partition by query_id order by bm25 desc, id) as rank from bm) where rank <= {k})"""


def corpus(t):
    return b.records(t).select("id", F.col("statement").alias("text"))


def candidates(t, k: int = 20):
    return lexical.bm25_top_k(b.queries(t).select("query_id", "query"), corpus(t), k)


@query("j5_bm25_topk", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(20)) + "select query_id, id, rank, bm25 from top")
def j5(t):
    return candidates(t).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "bm25")


@query("j5_bm25_filtered", b.cte(b.RECORDS.replace("from documents)", "from documents where lang = 'en' and source <> 'src3')"), b.QUERIES, BM25, bm_top(10))
       + "select query_id, id, rank from top")
def j5_filtered(t):
    visible = b.records(t).where("lang = 'en' and node <> 'src3'").select("id", F.col("statement").alias("text"))
    top = lexical.bm25_top_k(b.queries(t).select("query_id", "query"), visible, 10)
    return top.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


def gold_texts(t):
    """Two golds per query: the passage and its second half."""
    half = F.expr("substring(text, cast(length(text) div 2 as int) + 1)")
    q = b.queries(t)
    return q.select("query_id", F.lit(0).alias("gold_id"), F.col("text").alias("gold")).unionByName(
        q.select("query_id", F.lit(1).alias("gold_id"), half.alias("gold"))
    )


GOLDS = f"""golds as (select query_id, 0 as gold_id, {b.sql_words('text')} as g from queries union all
  select query_id, 1, {b.sql_words("substring(text, length(text) // 2 + 1)")} from queries),
page as (select top.query_id, top.rank, {b.sql_words('r.statement')} as c from top join records r on r.id = top.id),
gr as (select g.query_id, g.gold_id, min(case when contains(c, g) then rank end) as gold_rank,
  min(case when contains(c, g) and rank <= 10 then rank end) as ranked_gold_rank from golds g left join page using (query_id) group by 1, 2)"""


def page_texts(t, k: int = 20):
    """The candidate page with its text joined after the limit."""
    return candidates(t, k).join(corpus(t), "id")


def gold_rank_table(t):
    return ev.gold_ranks(page_texts(t), gold_texts(t), ranked_prefix=10)


@query("j26_gold_containment", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(20), GOLDS) + "select query_id, gold_id, gold_rank, ranked_gold_rank from gr")
def j26(t):
    return gold_rank_table(t).select("query_id", "gold_id", F.col("gold_rank").cast("bigint").alias("gold_rank"), F.col("ranked_gold_rank").cast("bigint").alias("ranked_gold_rank"))


@query("j26_gold_pairs", b.cte(b.RECORDS, b.QUERIES, b.GOLD) + "select query_id, id from gold")
def j26_pairs(t):
    return b.gold(t)


QUESTIONS = """qs as (select query_id, 'c' || query_id % 3 as category, length(query) as context_chars, (query_id * 13 % 29)::double as duration_ms from queries),
sc as (select qs.*, count(gold_id) as golds, count(case when ranked_gold_rank <= 1 then 1 end) as h1, count(case when ranked_gold_rank <= 5 then 1 end) as h5,
  count(case when ranked_gold_rank <= 10 then 1 end) as h10, count(case when ranked_gold_rank <= 20 then 1 end) as h20, count(gold_rank) as hf,
  sum(coalesce(1.0::double / ranked_gold_rank, 0)) as rr, min(ranked_gold_rank) as fr from qs left join gr using (query_id) group by all)"""

METRICS = """count(*) as questions, count(case when golds > 0 then 1 end) as questions_with_golds, sum(golds)::bigint as golds,
  round(sum(h1) / sum(golds)::double, 6) as recall_1, round(sum(h5) / sum(golds)::double, 6) as recall_5, round(sum(h10) / sum(golds)::double, 6) as recall_10, round(sum(h20) / sum(golds)::double, 6) as recall_20,
  round(avg(case when hf > 0 then 1.0 else 0 end)::double, 6) as any_rate, round(avg(case when hf = golds then 1.0 else 0 end)::double, 6) as all_rate,
  round(avg(case when fr <= 20 then 1.0 else 0 end)::double, 6) as any_at_k, round(avg(case when h20 = golds then 1.0 else 0 end)::double, 6) as all_at_k,
  round(sum(rr) / sum(golds), 6) as mrr_gold, round(avg(coalesce(1.0::double / fr, 0)), 6) as mrr_question, round(avg(context_chars)::double, 6) as mean_context_chars,
  quantile_disc(duration_ms, 0.5) as latency_p50, quantile_disc(duration_ms, 0.95) as latency_p95"""


def scored_questions(t):
    q = b.queries(t)
    questions = q.select(
        "query_id", F.concat(F.lit("c"), F.col("query_id") % 3).alias("category"), F.length("query").alias("context_chars"),
        (F.col("query_id") * 13 % 29).cast("double").alias("duration_ms"),
    )
    return ev.question_scores(gold_rank_table(t), questions)


HYBRID = r"""txt as (select 'd' || id as key, statement as text from records union all select 'q' || query_id, query from queries),
tok as (select key, u.w from txt, unnest(regexp_extract_all(lower(trim(text, e' \t\n\r')), '[\p{L}\p{N}_+.#-]+')) as u(w)),
feat as (select key, w as f from tok union all select key, substr(w, i::int, 3) from tok, unnest(range(1, length(w) - 1)) as r(i)),
hashed as (select f, list_reduce(list_concat([2166136261::ubigint], [ord(c)::ubigint for c in regexp_extract_all(f, '.')]), lambda h, c: (xor(h, c) * 16777619::ubigint) & 4294967295::ubigint) as h from (select distinct f from feat)),
dims as (select key, (h % 256)::bigint as bucket, sum(case when h % 2 = 0 then 1 else -1 end)::double as v from feat join hashed using (f) group by 1, 2),
nrm as (select key, sqrt(sum(v * v)) as n from dims where v <> 0 group by 1),
hv as (select substr(q.key, 2)::bigint as query_id, substr(d.key, 2)::bigint as id, round(greatest(-1, least(1, sum(q.v * d.v) / (any_value(a.n) * any_value(z.n)))), 6) as cosine
  from dims q join dims d on d.bucket = q.bucket join nrm a on a.key = q.key join nrm z on z.key = d.key where q.key like 'q%' and d.key like 'd%' group by 1, 2),
ht as (select * from (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from hv where cosine > 0) where rank <= 20),
un as (select query_id, id from top union select query_id, id from ht),
hy as (select query_id, id, coalesce(bm25, 0) as bm25, coalesce(cosine, 0) as cosine,
  round(case when coalesce(bm25, 0) <= 0 then 0 else bm25 / (bm25 + 10) * 0.5 end + greatest(0, coalesce(cosine, 0)) * 0.35, 9) as score from un left join bm using (query_id, id) left join hv using (query_id, id)),
hr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from hy)"""


@query("j8_hybrid_documents", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(20), HYBRID) + "select query_id, id, bm25, cosine, score, rank from hr where rank <= 10")
def j8_documents(t):
    """BM25 and hashed vectors of the same documents, each scored by both routes."""
    return fuse.hybrid_candidates(b.queries(t).select("query_id", "query"), corpus(t)).select("query_id", "id", "bm25", "cosine", "score", F.col("rank").cast("bigint").alias("rank"))


@query("a17_retrieval_metrics", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(20), GOLDS, QUESTIONS) + f"select {METRICS} from sc")
def a17(t):
    return ev.retrieval_metrics(scored_questions(t))


@query("a18_metrics_by_category", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(20), GOLDS, QUESTIONS) + f"select coalesce(category, 'overall') as category, {METRICS} from sc group by rollup (category)")
def a18(t):
    return ev.retrieval_metrics(scored_questions(t), by="category")


VEC_SCORES = """vs as (select query_id, id, label, qlabel, round(greatest(-1, least(1, list_dot_product(qe, ce) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(ce, ce))))), 6) as cosine from qv, cv),
vtop as (select * from (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from vs where cosine > 0) where rank <= {k})"""


@query("j6_vector_topk", b.cte(b.VECTORS, VEC_SCORES.format(k=20)) + "select query_id, id, cosine, rank from vtop")
def j6(t):
    top = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 20)
    return top.select("query_id", "id", "cosine", F.col("rank").cast("bigint").alias("rank"))


@query("j6_vector_topk_grid", b.cte(b.VECTORS, VEC_SCORES.format(k=5)) + "select query_id, id, cosine, rank from vtop")
def j6_grid(t):
    """The same answer through the block-by-shard way used for large query sets."""
    top = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 5, limit=4)
    return top.select("query_id", "id", "cosine", F.col("rank").cast("bigint").alias("rank"))
