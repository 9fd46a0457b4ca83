"""Fusion, re-ranking, budgets and query-performance signals over vector shortlists."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.functions import text as tx
from keelson.operators import budget as bg, dense, fuse
from keelson.plans import bindings as b
from keelson.plans.retrieval import VEC_SCORES
from keelson.registry import query

c = F.col

# Shortlist of 40 vector candidates per query with synthetic lexical and route scores.
SL = ",\n".join([b.VECTORS, VEC_SCORES.format(k=40), """
sl0 as (select query_id, id, label as node, qlabel, cosine, case when (id + query_id) % 3 = 0 then 0.0 else (id * 7919 % 101) / 10.0 end::double as bm25, (id % 5) / 10.0::double as route,
  (id % 4)::int as tier, (20 + id * 13 % 180)::int as tokens, (100 + id * 31 % 900)::int as chars, ['fact','preference','state','event','constraint','conversation_evidence','strategy'][1 + id % 7] as memory_type,
  id % 5 <> 0 as direct, case when id % 4 = 0 then 'hybrid_match' else 'vector_match' end as reason from vtop),
sl1 as (select *, round(case when bm25 <= 0 then 0 else bm25 / (bm25 + 10) * 0.5 end + greatest(0, cosine) * 0.35 + greatest(0, route) * 0.15, 9) as score from sl0),
sl as (select *, row_number() over (partition by query_id order by score desc, id) as position from sl1)"""])


def shortlist(t):
    top = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 40)
    labels = b.vector_corpus(t).select("id", c("label").alias("node"))
    qlabels = b.vector_queries(t).select("query_id", c("label").alias("qlabel"))
    kinds = F.array(*[F.lit(x) for x in ("fact", "preference", "state", "event", "constraint", "conversation_evidence", "strategy")])
    k = c("id")
    rows = top.join(labels, "id").join(qlabels, "query_id").select(
        "query_id", "id", "node", "qlabel", "cosine",
        F.when((k + c("query_id")) % 3 == 0, 0.0).otherwise((k * 7919 % 101) / 10.0).alias("bm25"), ((k % 5) / 10.0).alias("route"),
        (k % 4).cast("int").alias("tier"), (k * 13 % 180 + 20).cast("int").alias("tokens"), (k * 31 % 900 + 100).cast("int").alias("chars"),
        F.get(kinds, (k % 7).cast("int")).alias("memory_type"), (k % 5 != 0).alias("direct"),
        F.when(k % 4 == 0, "hybrid_match").otherwise("vector_match").alias("reason"),
    )
    scored = rows.withColumn("score", F.round(fuse.hybrid_score(c("bm25"), c("cosine"), c("route")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("position", F.row_number().over(w))


def lists(t):
    """Vector, lexical and hybrid rankings of the shortlist."""
    s = shortlist(t)
    rank = lambda col: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(col), "id"))
    return (
        s.withColumn("rank", rank("cosine")), s.where("bm25 > 0").withColumn("rank", rank("bm25")), s.withColumn("rank", c("position")),
    )


RANKS = """vr as (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from sl),
lr as (select *, row_number() over (partition by query_id order by bm25 desc, id) as rank from sl where bm25 > 0)"""


@query("j8_hybrid_union", b.cte(SL, RANKS) + """
select coalesce(l.query_id, v.query_id) as query_id, coalesce(l.id, v.id) as id, l.rank as lexical_rank, v.rank as vector_rank, case when v.id is null then round(x.cosine, 6) else v.cosine end as cosine
from (select * from lr where rank <= 15) l full join (select * from vr where rank <= 15) v on l.query_id = v.query_id and l.id = v.id
left join vs x on x.query_id = coalesce(l.query_id, v.query_id) and x.id = coalesce(l.id, v.id)""")
def j8(t):
    """Union of both routes; the missing vector side is scored for exactly those pairs."""
    vector, lexical, _ = lists(t)
    union = fuse.hybrid_union(lexical.where("rank <= 15"), vector.where("rank <= 15"))
    missing = union.where("cosine is null").select("query_id", "id")
    scored = dense.pair_cosines(missing, b.vector_corpus(t), b.vector_queries(t)).select("query_id", "id", c("cosine").alias("cross"))
    return union.join(scored, ["query_id", "id"], "left").select(
        "query_id", "id", c("lexical_rank").cast("bigint").alias("lexical_rank"), c("vector_rank").cast("bigint").alias("vector_rank"),
        F.coalesce("cosine", "cross").alias("cosine"),
    )


ROUTES = "routes as (select query_id, id, 1 as route, rank as position, 1.0::double as weight from vr union all select query_id, id, 2, rank, 0.5::double from lr)"


@query("w1_reciprocal_rank_fusion", b.cte(SL, RANKS, ROUTES) + """
select * from (select query_id, id, score, best_rank, row_number() over (partition by query_id order by score desc, best_rank, id) as rank from (
  select query_id, id, round(sum(weight / (60 + position)), 9) as score, min(position) as best_rank from routes group by 1, 2)) where rank <= 20""")
def w1(t):
    vector, lexical, _ = lists(t)
    route = lambda df, n, weight: df.select("query_id", "id", F.lit(n).alias("route"), c("rank").alias("position"), F.lit(weight).alias("weight"))
    fused = fuse.reciprocal_rank_fusion(route(vector, 1, 1.0).unionByName(route(lexical, 2, 0.5)), 20)
    return fused.select("query_id", "id", "score", c("best_rank").cast("bigint").alias("best_rank"), c("rank").cast("bigint").alias("rank"))


@query("w2_local_log_odds", b.cte(SL, """
st as (select query_id, median(case when cosine > 0 then cosine end) as mv, stddev_pop(case when cosine > 0 then cosine end) as sv, median(case when bm25 > 0 then bm25 end) as ml, stddev_pop(case when bm25 > 0 then bm25 end) as sdl from sl group by 1),
sc as (select query_id, id, round(case when bm25 > 0 then sqrt(2) * (0.75 * (cosine - mv) / sv + 0.25 * (bm25 - ml) / sdl) else (cosine - mv) / sv end, 9) as score from sl join st using (query_id))""") + """
select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from sc""")
def w2(t):
    out = fuse.local_log_odds(shortlist(t))
    return out.select("query_id", "id", "score", c("rank").cast("bigint").alias("rank"))


@query("w3_hybrid_topk", b.cte(SL) + "select query_id, id, score, position from sl where position <= 10")
def w3(t):
    return shortlist(t).where("position <= 10").select("query_id", "id", "score", c("position").cast("bigint").alias("position"))


@query("w4_shortlist_interleave", b.cte(SL, RANKS, """
pr as (select query_id, id, case when position <= 5 then [0, position, 0] else [1, position, 2] end as p from sl
  union all select query_id, id, [1, rank, 0] from vr union all select query_id, id, [1, rank, 1] from lr),
mn as (select query_id, id, min(p) as p from pr group by 1, 2)""") + """
select * from (select query_id, id, row_number() over (partition by query_id order by p) as rank from mn) where rank <= 12""")
def w4(t):
    vector, lexical, hybrid = lists(t)
    out = fuse.shortlist(hybrid, vector, lexical, 12, reserved=5)
    return out.select("query_id", "id", c("rank").cast("bigint").alias("rank"))


TEXT_CANDIDATES = """tc0 as (select q.query_id, r.id, q.query, r.statement as text, r.tier as score, r.tier, r.importance, r.memory_type,
   row_number() over (partition by q.query_id order by r.tier desc, r.id) as position from queries q join records r on r.node = 'src' || (q.query_id % 20)),
tc as (select *, ((id * 7919 % 101) / 10.0)::double as lexical, ((id % 17) / 17.0)::double as vector, ((id % 5) / 10.0)::double as route from tc0 where position <= 40)"""


def text_candidates(t):
    """Forty same-source records per query with their text."""
    q = b.queries(t).select("query_id", "query", F.concat(F.lit("src"), c("query_id") % 20).alias("node"))
    r = b.records(t).select("id", "node", c("statement").alias("text"), c("tier").alias("score"), "tier", "importance", "memory_type")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # Rank on the narrow columns first; the text joins back for the forty kept rows only.
    kept = r.select("id", "node", "score").join(q.select("query_id", "node"), "node").withColumn("position", F.row_number().over(w)).where("position <= 40")
    rows = kept.select("query_id", "id", "position").join(r, "id").join(q.select("query_id", "query"), "query_id")
    k = c("id")
    return rows.select(
        "query_id", "id", "query", "text", "score", "tier", "importance", "memory_type", "position", ((k * 7919 % 101) / 10.0).alias("lexical"),
        ((k % 17) / 17.0).alias("vector"), ((k % 5) / 10.0).alias("route"),
    )


@query("w5_tie_rerank", b.cte(b.RECORDS, b.QUERIES, TEXT_CANDIDATES, r"""
h as (select distinct query_id, id, u.w from tc, unnest(list_intersect([x for x in regexp_extract_all(lower(query), '[\p{L}\p{N}_'']+') if length(x) >= 2], [x for x in regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') if length(x) >= 2])) as u(w)),
n as (select query_id, count(*) as n from tc group by 1), df as (select query_id, w, count(*) as df from h group by 1, 2),
cov as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 6) as coverage from h join df using (query_id, w) join n using (query_id) group by 1, 2)""") + """
select tc.query_id, tc.id, coalesce(coverage, 0) as coverage, row_number() over (partition by tc.query_id order by score desc, coalesce(coverage, 0) desc, position) as rank from tc left join cov using (query_id, id)""")
def w5(t):
    out = fuse.tie_rerank(text_candidates(t), "score", "position")
    return out.select("query_id", "id", "coverage", c("rank").cast("bigint").alias("rank"))


@query("w6_usefulness_order", b.cte(SL, """
q as (select *, ['how many of them', 'please recommend one', 'what the assistant said', 'plain'][1 + (query_id // 50) % 4] as query from sl),
u as (select *, round(score + case when query like 'how%' and memory_type in ('event', 'fact', 'state') then 0.25 when query like 'how%' and memory_type = 'conversation_evidence' then -0.15 when query like 'how%' and memory_type = 'strategy' then -0.1
  when query like 'please%' and memory_type = 'preference' then 0.3 when query like 'please%' and memory_type = 'constraint' then 0.15 when query like 'what%' and memory_type = 'conversation_evidence' then 0.25 else 0 end, 9) as usefulness from q)""") + """
select * from (select query_id, id, usefulness, row_number() over (partition by query_id order by usefulness desc, position) as rank from u) where rank <= 15""")
def w6(t):
    s = shortlist(t).withColumn("query", query_text())
    u = s.withColumn("usefulness", F.round(fuse.usefulness(c("score"), c("memory_type"), F.lower("query")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("usefulness"), "position")
    return u.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("query_id", "id", "usefulness", c("rank").cast("bigint").alias("rank"))


def query_text():
    kinds = F.array(*[F.lit(x) for x in ("how many of them", "please recommend one", "what the assistant said", "plain")])
    return F.get(kinds, (F.floor(c("query_id") / 50) % 4).cast("int"))


STATS = """gs as (select *, greatest(0, bm25) * 0.5 + greatest(0, cosine) * 0.35 + greatest(0, route) * 0.15 as raw from sl),
ga as (select query_id, count(*) as n, avg(raw) as mean, stddev_pop(raw) as sd from gs group by 1)"""


@query("a14_score_stats", b.cte(SL) + """
select query_id, count(*) as count, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd, round(stddev_pop(score) / avg(score), 6) as cv, round(max(score), 6) as top1,
  round(max(case when position = 2 then score end), 6) as top2 from sl group by 1""")
def a14(t):
    s = fuse.score_stats(shortlist(t))
    return s.select("query_id", "count", *[F.round(x, 6).alias(x) for x in ("mean", "sd", "cv", "top1", "top2")])


@query("f16_relevance_gate", b.cte(SL, STATS) + """
select * from (select query_id, id, row_number() over (partition by query_id order by position) as kept from gs join ga using (query_id)
 where score >= 0.3 and (raw - mean) / sd >= -0.5 and not (n >= 3 and sd / mean < 0.3)) where kept <= 12""")
def f16(t):
    s = shortlist(t).withColumnRenamed("bm25", "lexical").withColumnRenamed("cosine", "vector")
    out = fuse.relevance_gate(s, floor=0.3, limit=12, min_z=-0.5, max_cv=0.3, position="position")
    w = Window.partitionBy("query_id").orderBy("position")
    return out.select("query_id", "id", F.row_number().over(w).cast("bigint").alias("kept"))


def qpp_rows(t):
    return shortlist(t).withColumn("strength", c("score")).where("position <= 20")


QPP = """qr as (select *, case when direct then score end as d from sl where position <= 20),
qa as (select query_id, count(d) as n, count(*) as total, coalesce(max(d), 0) as top1, avg(d) as mean, stddev_pop(d) as sd, list(d order by position) filter (d is not null) as ds, count(case when direct and reason <> 'hybrid_match' then 1 end) as healthy from qr group by 1),
qc as (select query_id, n, total, top1, case when n < 2 then 0 else least(1, sd * 2) end as variance, case when n < 2 or mean <= 1e-9 then 0 else least(1, sd / mean) end as nqc,
  case when n < 2 then 0 else greatest(0, least(1, (ds[1] - ds[2]) / ds[1])) end as top_gap, healthy / n::double as reason_health, (total - n) / total::double as dependence from qa)"""


@query("a10_qpp_components", b.cte(SL, QPP) + """
select query_id, n as direct_count, total as total_count, round(top1, 6) as top1, round(variance, 6) as variance, round(nqc, 6) as nqc, round(top_gap, 6) as top_gap, round(reason_health, 6) as reason_health,
  round(dependence, 6) as expansion_dependence, round((1 - top1) * dependence, 6) as expansion_risk, round(top1 + 0.5 * nqc, 6) as qpp from qc""")
def a10(t):
    out = fuse.qpp_per_query(qpp_rows(t))
    six = ("top1", "variance", "nqc", "top_gap", "reason_health", "expansion_dependence", "expansion_risk", "qpp")
    return out.select("query_id", "direct_count", "total_count", *[F.round(x, 6).alias(x) for x in six])


@query("a10_intent_coverage", b.cte(SL, """
q as (select query_id, ['how many of them', 'please recommend one', 'what the assistant said', 'plain'][1 + (query_id // 50) % 4] as query, list(memory_type) as types from sl where position <= 3 group by 1, 2)""") + """
select query_id, case when query like 'how%' then len(list_intersect(types, ['derived', 'event', 'fact', 'state'])) > 0 when query like 'please%' then len(list_intersect(types, ['preference', 'constraint'])) > 0
  when query like 'what%' then list_contains(types, 'conversation_evidence') end as covered, case when query = 'plain' then 0.5 end as neutral from q""")
def a10_intent(t):
    out = fuse.intent_coverage(shortlist(t).where("position <= 3").withColumn("query", query_text()))
    return out.select(
        "query_id", F.when(c("intent_coverage") != 0.5, c("intent_coverage") == 1).alias("covered"), F.when(c("intent_coverage") == 0.5, 0.5).alias("neutral")
    )


@query("a11_second_pass", b.cte(SL, QPP) + """
select query_id, case when n > 0 and reason_health = 0 then 'guardrail_all_fallback' when top1 < 0.2 then 'guardrail_low_top1' when top1 + 0.5 * nqc < 0.8 then 'below_threshold' else 'ok' end as reason from qc""")
def a11(t):
    rows = qpp_rows(t)
    whole = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = rows.withColumns(fuse.qpp_columns(whole)).groupBy("query_id").agg(*[F.first(x).alias(x) for x in fuse.qpp_columns(whole)])
    return fuse.qpp_decision(first, threshold=0.8).select("query_id", c("reason_code").alias("reason"))


@query("a15_sufficiency_features", b.cte(SL, """
f as (select *, case when position between 2 and 9 then lag(score) over w - 2 * score + lead(score) over w end as bend from sl window w as (partition by query_id order by score desc, id)),
a as (select query_id, max(score) as top1, max(case when position = 2 then score end) as second, min(case when position <= 10 then score end) as tenth, stddev_pop(case when position <= 10 then score end) as sd10,
  regr_slope(case when position <= 10 then score end, case when position <= 10 then position end) as slope, avg(case when position <= 3 then score end) - avg(case when position > 10 and position <= 30 then score end) as bimodal,
  sum(case when position <= 5 then score end) / sum(score) as conc, greatest(0, max(bend)) as elbow, count(*) as n, count(case when score >= 0.5 then 1 end) as above from f group by 1)""") + """
select query_id, round(top1, 6) as top1, round(top1 - second, 6) as top_gap, round((top1 - second) / (top1 - tenth), 6) as gap_concentration, round(sd10, 6) as top10_std, round(slope, 6) as decay_slope, round(bimodal, 6) as bimodal_gap,
  round(conc, 6) as top5_concentration, round(elbow, 6) as elbow, n as list_length, above as nn_above_tau, round(top1 - 0.5, 6) as margin_over_tau from a""")
def a15(t):
    f = fuse.shape_features(shortlist(t), 0.5)
    six = ("top1", "top_gap", "gap_concentration", "top10_std", "decay_slope", "bimodal_gap", "top5_concentration", "elbow", "margin_over_tau")
    return f.select("query_id", "list_length", "nn_above_tau", *[F.round(x, 6).alias(x) for x in six])


@query("a15_query_surface", r"""
with w as (select item_id as id, text, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as words from benchmark)
select id, length(text) as query_chars, len(words)::bigint as query_words, round(list_sum([length(x) for x in words]) / len(words)::double, 6) as query_avg_word_length,
  case when regexp_matches(text, '[0-9]') then 1 else 0 end as query_has_numbers, len(regexp_extract_all(text, '[^\p{L}\p{N}\s]'))::bigint as query_punctuation from w""")
def a15_surface(t):
    f = fuse.surface_features(c("text"))
    return t.benchmark.select(
        c("item_id").alias("id"), f["query_chars"].cast("bigint").alias("query_chars"), f["query_words"].cast("bigint").alias("query_words"),
        F.round(f["query_avg_word_length"], 6).alias("query_avg_word_length"), f["query_has_numbers"].alias("query_has_numbers"),
        f["query_punctuation"].cast("bigint").alias("query_punctuation"),
    )


@query("a16_coverage_threshold", """
select value as threshold, (select count(*) from events) as queries from (select value, row_number() over (order by value desc) as r from events) where r = ceil(0.3 * (select count(*) from events))""")
def a16(t):
    return fuse.coverage_threshold(t.events.select(c("value").alias("score")), 0.3)


@query("a45_elbow_adaptive_k", b.cte(SL, """
g as (select query_id, position as r, round(score - lead(score) over (partition by query_id order by score desc, id), 12) as gap, score from sl),
f as (select *, row_number() over (partition by query_id order by gap desc nulls last, r) as k from g),
e as (select query_id, max(case when k = 1 then r end) as cliff, max(gap) as gap, max(score) as top, count(*) as n from f group by 1)""") + """
select query_id, case when gap > 0.05 * top then cliff end as elbow, least(greatest(cliff + 5, 1), 34, greatest(1, floor(n * 0.9)))::bigint as k from e""")
def a45(t):
    s = shortlist(t)
    k = fuse.adaptive_k(s).select("query_id", "k")
    return fuse.elbow(s, min_relative=0.05).select("query_id", c("elbow").cast("bigint").alias("elbow")).join(k, "query_id")


@query("a37_clause_contribution", b.cte(SL, """
cl as (select query_id, id, 0 as clause, score from sl where id % 2 = 0 union all select query_id, id, 1, score * 0.9 from sl where id % 3 = 0 union all select query_id, id, 2, cosine from sl where id % 5 = 0),
fu as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, max(score) as score, list(distinct clause) as clauses from cl group by 1, 2)) where rank <= 10)""") + """
select u.clause, count(*) as contributed, count(case when len(clauses) = 1 then 1 end) as exclusive from fu, unnest(clauses) as u(clause) group by 1""")
def a37(t):
    return fuse.clause_contribution(fuse.clause_fusion(clause_lists(t), 10))


def clause_lists(t):
    s = shortlist(t)
    part = lambda cond, n, score: s.where(cond).select("query_id", "id", F.lit(n).alias("clause"), score.alias("score"))
    return part("id % 2 = 0", 0, c("score")).unionByName(part("id % 3 = 0", 1, c("score") * 0.9)).unionByName(part("id % 5 = 0", 2, c("cosine")))


CL = """cl as (select query_id, id, 0 as clause, score from sl where id % 2 = 0 union all select query_id, id, 1, score * 0.9 from sl where id % 3 = 0 union all select query_id, id, 2, cosine from sl where id % 5 = 0)"""


@query("u1_clause_fusion", b.cte(SL, CL) + """
select query_id, id, score, sources, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (
  select query_id, id, max(score) as score, count(distinct clause) as sources from cl group by 1, 2)) where rank <= 20""")
def u1(t):
    f = fuse.clause_fusion(clause_lists(t), 20)
    return f.select("query_id", "id", "score", "sources", c("rank").cast("bigint").alias("rank"))


@query("u2_append_supplement", b.cte(SL) + "select query_id, id from sl where tier = 1 and position > 10")
def u2(t):
    s = shortlist(t)
    page = s.where("position <= 10").select("query_id", "id")
    return s.where("tier = 1").select("query_id", "id").join(page, ["query_id", "id"], "left_anti")


@query("u3_candidate_union", b.cte(SL, CL) + "select query_id, count(distinct id) as union_size, count(*) as path_sum, count(distinct clause) as calls from cl group by 1")
def u3(t):
    return clause_lists(t).groupBy("query_id").agg(F.count_distinct("id").alias("union_size"), F.count("*").alias("path_sum"), F.count_distinct("clause").alias("calls"))


@query("u4_arm_identity_diff", b.cte(SL, RANKS) + """
select query_id, id, sl.position as hybrid_position, vr.rank as vector_position from sl join vr using (query_id, id) where sl.position <> vr.rank""")
def u4(t):
    vector, _, hybrid = lists(t)
    v = vector.select("query_id", "id", c("rank").alias("v"))
    both = hybrid.select("query_id", "id", c("rank").alias("h")).join(v, ["query_id", "id"], "full_outer")
    return both.where(~c("h").eqNullSafe(c("v"))).select("query_id", "id", c("h").cast("bigint").alias("hybrid_position"), c("v").cast("bigint").alias("vector_position"))


@query("u5_target_overlap", """
select l_partkey as id from lineitem where l_shipdate < timestamp '1998-01-01' intersect select l_partkey from lineitem where l_shipdate >= timestamp '2000-01-01' and l_returnflag = 'R'""")
def u5(t):
    cut = lambda s: F.expr(f"timestamp_ntz'{s} 00:00:00'")
    train = t.lineitem.where(c("l_shipdate") < cut("1998-01-01")).select(c("l_partkey").alias("id"))
    held = t.lineitem.where((c("l_shipdate") >= cut("2000-01-01")) & (c("l_returnflag") == "R")).select(c("l_partkey").alias("id"))
    return train.intersect(held)


@query("u6_trace_merge", b.cte(SL) + """
select query_id, array_to_string(list_sort(list_distinct(list_concat(list(id) filter (position <= 3), list(id) filter (position <= 20 and id % 3 = 0)))), ',') as disclosed from sl group by 1""")
def u6(t):
    """Reported ids count only when returned; earlier disclosed ids stay."""
    s = shortlist(t)
    trace = s.groupBy("query_id").agg(
        F.collect_list(F.when(c("position") <= 20, c("id"))).alias("returned"), F.collect_list(F.when(c("position") <= 3, c("id"))).alias("earlier"),
        F.collect_list(F.when(c("id") % 3 == 0, c("id"))).alias("reported"),
    )
    merged = F.array_union("earlier", F.array_intersect("reported", "returned"))
    return trace.select("query_id", F.array_join(F.sort_array(merged), ",").alias("disclosed"))


@query("u7_normalized_fusion", b.cte(SL, CL, """
mm as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as ns from cl window w as (partition by query_id, clause))""") + """
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from (
  select query_id, id, max(ns) as score from mm group by 1, 2)) where rank <= 20""")
def u7(t):
    f = fuse.normalized_fusion(clause_lists(t), 20)
    return f.select("query_id", "id", "score", c("rank").cast("bigint").alias("rank"))


@query("w8_source_dedup", b.cte(SL) + """
select query_id, id, row_number() over (partition by query_id order by position) as rank, round(case when id % 6 = 0 then 1.0 / row_number() over (partition by query_id order by position) else least(score, 1) end, 9) as utility from (
  select *, row_number() over (partition by query_id, id % 11 order by position) as copy from sl) where copy = 1""")
def w8(t):
    """First row per source text; an invalid ranker score falls back to the reciprocal rank."""
    first = Window.partitionBy("query_id", c("id") % 11).orderBy("position")
    eligible = shortlist(t).withColumn("copy", F.row_number().over(first)).where("copy = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    ranked = eligible.withColumn("rank", rank).where("rank <= 100").withColumn("given", F.when(c("id") % 6 == 0, F.lit(7.5)).otherwise(F.least(c("score"), F.lit(1.0))))
    valid = F.when(c("given").between(0, 1), c("given"))
    return ranked.select("query_id", "id", c("rank").cast("bigint").alias("rank"), F.round(F.coalesce(valid, 1 / c("rank")), 9).alias("utility"))


GREEDY = """bq as (select query_id, position, id, node, tier, tokens from sl),
rec as (select query_id, 1::bigint as p, []::bigint[] as ids, []::bigint[] as nodes, 0::bigint as tokens, 0 as deep, false as xe, false as xn, false as xd, false as xt from (select distinct query_id from bq)
 union all
 select r.query_id, r.p + 1,
  case when take then list_append(ids, b.id) else ids end, case when take and new_node then list_append(nodes, b.node::bigint) else nodes end,
  r.tokens + case when take then b.tokens else 0 end, deep + case when take and b.tier >= 2 then 1 else 0 end, xe or f_full, xn or f_node, xd or f_deep, xt or f_tok
 from rec r join bq b on b.query_id = r.query_id and b.position = r.p,
 lateral (select len(ids) >= 10 as f_full, not list_contains(nodes, b.node::bigint) as new_node) l1,
 lateral (select not f_full and new_node and len(nodes) >= 5 as f_node) l2,
 lateral (select not f_full and not f_node and b.tier >= 2 and deep >= 3 as f_deep) l3,
 lateral (select not f_full and not f_node and not f_deep and len(ids) > 0 and r.tokens + b.tokens > 900 as f_tok) l4,
 lateral (select not (f_full or f_node or f_deep or f_tok) as take) l5),
fin as (select * from rec where p = (select count(*) + 1 from bq where bq.query_id = rec.query_id))"""

W9_BUDGET = {**bg.DEFAULT_BUDGET, "nodes": 5, "evidence": 10, "tokens": 900, "tier_budget": 3}


@query("w9_greedy_budget", b.cte(SL, GREEDY).replace("with ", "with recursive ", 1) + """
select query_id, array_to_string(ids, ',') as selected, tokens, deep, xe as x_evidence, xn as x_nodes, xd as x_deep, xt as x_tokens from fin""")
def w9(t):
    s = bg.greedy_selection(shortlist(t), W9_BUDGET, 10)
    return s.select("query_id", F.array_join("ids", ",").alias("selected"), "tokens", "deep", "x_evidence", "x_nodes", "x_deep", "x_tokens")


@query("w10_budget_ledger", b.cte(SL, GREEDY).replace("with ", "with recursive ", 1) + """
select query_id, 'nodes' as dimension, 5::bigint as limit, len(nodes)::bigint as used, xn or len(nodes) >= 5 as exhausted from fin
union all select query_id, 'evidence', 10, len(ids), xe or len(ids) >= 10 from fin union all select query_id, 'tokens', 900, tokens, xt or tokens >= 900 from fin
union all select query_id, 'deepEvidence', 3, deep, xd or deep >= 3 from fin""")
def w10(t):
    return bg.ledger(bg.greedy_selection(shortlist(t), W9_BUDGET, 10), W9_BUDGET)


RUNNING = """wr as (select *, case when direct then score end as d from sl),
wc as (select query_id, position, count(d) over w as n, count(*) over w as total, coalesce(max(d) over w, 0) as top1, avg(d) over w as mean, stddev_pop(d) over w as sd,
  count(case when direct and reason <> 'hybrid_match' then 1 end) over w as healthy, first_value(d) over (partition by query_id order by position) as d1 , score, direct
  from wr window w as (partition by query_id order by position rows unbounded preceding)),
wd as (select *, case when n < 2 or mean <= 1e-9 then 0 else least(1, sd / mean) end as nqc from wc),
we as (select *, top1 + 0.5 * nqc as qpp, (n > 0 and healthy = 0) or top1 < 0.2 or top1 + 0.5 * nqc < 0.55 as trig from wd),
wg as (select query_id, coalesce(max(case when position = 2 and direct then (d1 - score) / d1 end), 0) as gap from we group by 1),
wt as (select we.*, case when gap >= 0.05 then 3 else 13 end as start from we join wg using (query_id)),
wx as (select * from wt where position in (1, 2, 3, 5, 8, 13, 21, 34, 40) and position >= start and (not trig or position >= 40))"""


@query("w11_fibonacci_walk", b.cte(SL, RUNNING) + """
select query_id, any_value(start)::bigint as start, min(position) as selected, round(arg_min(qpp, position), 6) as qpp, case when not arg_min(trig, position) then 'sufficient' else 'candidate_pool_exhausted' end as stopped_because from wx group by 1""")
def w11(t):
    out = bg.fibonacci_walk(shortlist(t).withColumn("strength", c("score")), 40)
    return out.select("query_id", c("start").cast("bigint").alias("start"), c("selected").cast("bigint").alias("selected"), F.round("qpp", 6).alias("qpp"), "stopped_because")


@query("w12_tier_walk", b.cte(SL, """
o as (select query_id, u.t as open, count(case when direct then 1 end) as n, coalesce(max(case when direct then score end), 0) as top1, avg(case when direct then score end) as mean, stddev_pop(case when direct then score end) as sd,
  count(case when direct and reason <> 'hybrid_match' then 1 end) as healthy from sl, (values (0), (1), (2), (3)) u(t) where tier <= u.t group by 1, 2),
d as (select *, (n > 0 and healthy = 0) or top1 < 0.2 or top1 + 0.5 * case when n < 2 or mean <= 1e-9 then 0 else least(1, sd / mean) end < 0.55 as trig from o)""") + """
select q.query_id, coalesce(min(case when not trig then open end), 3)::bigint as opened_tier from (select distinct query_id from sl) q left join d using (query_id) group by 1""")
def w12(t):
    out = bg.tier_walk(shortlist(t).withColumn("strength", c("score")), 3)
    return out.select("query_id", c("opened_tier").cast("bigint").alias("opened_tier"))


@query("w13_warm_halves", b.cte(SL) + """
select query_id, id, tier = 1 and count(*) over (partition by query_id, tier = 1) >= 5 and row_number() over (partition by query_id, tier = 1 order by position) > ceil(count(*) over (partition by query_id, tier = 1) / 2.0) as deferred from sl""")
def w13(t):
    return bg.warm_fold(shortlist(t)).select("query_id", "id", "deferred")


@query("w14_char_budget", b.cte(SL) + """
select query_id, id, used from (select *, sum(chars) over (partition by query_id order by position rows unbounded preceding)::bigint as used from sl) where used <= 2500 or position = 1""")
def w14(t):
    return bg.char_prefix(shortlist(t), 2500).select("query_id", "id", "used")


@query("w15_evidence_packing")
def w15(t):
    items = shortlist(t).withColumn("utility", F.least(c("score"), F.lit(1.0))).withColumn("key", (c("id") % 23).cast("string"))
    return bg.pack_evidence(items)


@query("w16_staged_recall", b.cte(SL, """
od as (select *, row_number() over (partition by query_id order by round(40.0 / (40 + position - 1) / pow(greatest(chars, 400), 0.5), 12) desc, position) as o from sl)""") + """
select query_id, count(*) as rows, sum(chars)::bigint as total from od group by 1""")
def w16(t):
    """With room for the whole list every row is packed; the order itself is tested separately."""
    out = bg.staged_recall(shortlist(t), available=120_000)
    return out.select("query_id", F.size("ids").cast("bigint").alias("rows"), c("used").alias("total"))


@query("w16_recall_order", b.cte(SL) + """
select query_id, id, row_number() over (partition by query_id order by round(40.0 / (40 + position - 1) / pow(greatest(chars, 400), 0.5), 12) desc, position) as place from sl""")
def w16_order(t):
    score = F.round(bg.recall_order(c("position"), c("chars")), 12)
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "position")
    return shortlist(t).select("query_id", "id", F.row_number().over(w).cast("bigint").alias("place"))


@query("w17_fitting_page", b.cte(SL) + """
select query_id, id, used from (select *, sum(chars + 1) over (partition by query_id order by position rows unbounded preceding)::bigint as used from sl where position <= 30) where used <= 5500 * 1.5""")
def w17(t):
    return bg.fitting_page(shortlist(t), 30).select("query_id", "id", "used")


PAGE_KINDS = """pk as (select query_id, id, case when id % 6 = 0 then 'adjacent' when id % 6 = 1 then 'leaf' else 'ranked' end as kind, position from sl union all select query_id, id, 'leaf', position from sl where id % 6 = 2),
one as (select query_id, id, min([case kind when 'ranked' then 0 when 'adjacent' then 1 else 2 end, position]) as m from pk group by 1, 2),
num as (select *, m[1] as k, row_number() over (partition by query_id, m[1] order by m[2], id) as r from one),
qt as (select *, count(case when k = 1 then 1 end) over (partition by query_id) as na, count(case when k = 0 then 1 end) over (partition by query_id) as nr from num),
qu as (select *, least(na, 2) as qa, least(nr, 20 - least(na, 2)) as qr from qt)"""


@query("w18_reserved_page", b.cte(SL, PAGE_KINDS) + """
select query_id, id, case k when 0 then 'ranked' when 1 then 'adjacent' else 'leaf' end as kind, row_number() over (partition by query_id order by k, r) as slot from qu
where r <= case k when 0 then qr when 1 then qa else least(4, 20 - qa - qr) end""")
def w18(t):
    s = shortlist(t)
    k = c("id") % 6
    kinds = s.select("query_id", "id", F.when(k == 0, "adjacent").when(k == 1, "leaf").otherwise("ranked").alias("kind"), "position")
    again = s.where(k == 2).select("query_id", "id", F.lit("leaf").alias("kind"), "position")
    return bg.reserved_page(kinds.unionByName(again), 20).select("query_id", "id", "kind", c("slot").cast("bigint").alias("slot"))


@query("w19_recency_decay", """
select o_orderkey as id, round(o_totalprice * case when o_orderkey % 10 = 0 then 1 else pow(0.5, greatest(0, date_diff('day', o_orderdate::date, date '2002-01-01')) / 365.0) end, 4) as score from orders""")
def w19(t):
    time = F.when(c("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    s = bg.recency_decay(c("o_totalprice"), time, F.to_date(F.lit("2002-01-01")), 365.0)
    return t.orders.select(c("o_orderkey").alias("id"), F.round(s, 4).alias("score"))


@query("w20_hotness", b.cte(b.MEMORIES) + """
select id, round(log2(2 + access_count) * (0.5 + importance) * (0.5 + 1 / (1 + greatest(0, date_diff('day', created_at::date, date '2002-01-01')) / 30.0)), 6) as weight from memories""")
def w20(t):
    idle = F.date_diff(F.to_date(F.lit("2002-01-01")), F.to_date("created_at"))
    return b.memories(t).select("id", F.round(bg.hotness(c("access_count"), c("importance"), idle), 6).alias("weight"))


@query("w20_capacity_tiers")
def w20_tiers(t):
    """Optimal-code depths and capacity tiers inside (node, leaf) blocks of bounded size."""
    r = b.records(t)
    block = F.concat_ws(":", "node", F.floor(c("id") / 1000))
    items = r.select(block.alias("block"), "id", bg.hotness(c("id") % 6, c("importance"), c("id") % 400).alias("weight"))
    return bg.capacity_tiers(bg.weighted_depths(items), (4, 8, 16)).select("block", "id", c("depth").cast("bigint").alias("depth"), c("tier").cast("bigint").alias("tier"))


@query("w24_retained_mass", b.cte(SL, """
l as (select *, ln(p / (1 - p)) as lg from (select *, greatest(1e-6, least(1 - 1e-6, score)) as p from sl)),
m as (select *, exp(lg - max(lg) over (partition by query_id)) as mass from l),
s as (select *, round(coalesce(sum(mass) over (partition by query_id order by (case when position = 1 then 0 else 1 end), mass desc, position rows between unbounded preceding and 1 preceding), 0) / sum(mass) over (partition by query_id), 12) as share from m)""") + """
select query_id, id from s where position = 1 or share < 0.8""")
def w24(t):
    return fuse.retained_mass(shortlist(t), 0.8).select("query_id", "id")


PAIRS = """pa as (select a.query_id, a.id as a, a.rank as a_rank, b.id as b, b.rank as b_rank, list_dot_product(ca.ce, cb.ce) / (sqrt(list_dot_product(ca.ce, ca.ce)) * sqrt(list_dot_product(cb.ce, cb.ce))) as sim
  from vtop a join vtop b on a.query_id = b.query_id and a.id <> b.id join cv ca on ca.id = a.id join cv cb on cb.id = b.id where a.rank <= {n} and b.rank <= {n})"""


def vector_list(t, k=20):
    top = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), k)
    return top.join(b.vector_corpus(t).select("id", "embedding"), "id")


@query("w25_consistency_rerank", b.cte(b.VECTORS, VEC_SCORES.format(k=20), PAIRS.format(n=20), """
nr as (select query_id, a as id, avg(sim) as near from (select *, row_number() over (partition by query_id, a order by sim desc, b) as k from pa) where k <= 3 group by 1, 2),
cs as (select v.query_id, v.id, v.rank, round(0.7 * cosine + 0.3 * near, 9) as consistency from vtop v join nr using (query_id, id)),
cr as (select *, row_number() over (partition by query_id order by consistency desc, rank) as crank from cs)""") + """
select query_id, id, consistency, crank as consistency_rank, row_number() over (partition by query_id order by round(0.7 * crank + 0.3 * rank, 6), rank) as folded_rank from cr""")
def w25(t):
    out = fuse.consistency_rerank(vector_list(t), 20)
    return out.select("query_id", "id", "consistency", c("consistency_rank").cast("bigint").alias("consistency_rank"), c("folded_rank").cast("bigint").alias("folded_rank"))


@query("w26_fair_interleave", """
select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as turn, min(ts) over (partition by user_id) as scope_start from events""")
def w26(t):
    out = fuse.fair_order(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")
    return out.select("event_id", "user_id", c("turn").cast("bigint").alias("turn"), c("scope_start.ts").alias("scope_start"))


@query("w27_dispersion", b.cte(b.VECTORS, VEC_SCORES.format(k=20), """
e as (select *, exp(cosine - max(cosine) over (partition by query_id)) as x from vtop), p as (select *, x / sum(x) over (partition by query_id) as p from e),
po as (select query_id, avg(cosine) as mean_pool from vs where cosine > 0 group by 1),
g as (select query_id, avg(cosine) as mt, stddev_pop(cosine) as st, max(case when rank = 1 then cosine end) as t1, max(case when rank = 2 then cosine end) as t2, max(case when rank = 1 then p end) - max(case when rank = 2 then p end) as mg, exp(-sum(p * ln(p + 1e-12))) as ec from p group by 1)""") + """
select query_id, round((t1 - t2) / (t1 + 1e-9), 6) as margin, round(t1 / (mt + 1e-9), 6) as over_mean, round((t1 - mt) / (st + 1e-9), 5) as zscore, round(mg, 6) as mass_gap, round(ec, 5) as effective_count from g""")
def w27(t):
    s = vector_list(t).drop("embedding")
    out = fuse.dispersion_features(s, s)
    return out.select("query_id", F.round("margin", 6).alias("margin"), F.round("over_mean", 6).alias("over_mean"), F.round("zscore", 5).alias("zscore"), F.round("mass_gap", 6).alias("mass_gap"), F.round("effective_count", 5).alias("effective_count"))


@query("w27_coherence", b.cte(b.VECTORS, VEC_SCORES.format(k=8), PAIRS.format(n=8)) + """
select query_id, round(avg(sim), 6) as coherence, round(avg(case when a_rank = 1 and b_rank <= 5 then sim end), 6) as neighbourhood from pa group by 1""")
def w27_coherence(t):
    out = fuse.coherence_features(vector_list(t, 8))
    return out.select("query_id", F.round("coherence", 6).alias("coherence"), F.round("neighbourhood", 6).alias("neighbourhood"))
