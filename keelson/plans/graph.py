"""Graph walks, clustering, reverse retrieval and model-assisted scoring."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.functions import text as tx, vectors as vx
from keelson.operators import cells as cl, dense, fuse, learning as ml, lexical, topology as tp
from keelson.plans import bindings as b
from keelson.plans.fusion import SL, shortlist, text_candidates, TEXT_CANDIDATES
from keelson.plans.joins import graph_seeds
from keelson.plans.retrieval import BM25, VEC_SCORES, bm_top, candidates, corpus
from keelson.registry import query
from keelson.session import cut_lineage

c = F.col
big = lambda x, name=None: c(x).cast("bigint").alias(name or x)
r6 = lambda x, name=None: F.round(x, 6).alias(name or x)

# Typed edges: a stable hash decides which edges contradict or supersede.
TYPED = """te as (select edge_id, src, dst, strength, case when h % 11 = 0 then 'contradicts' when h % 13 = 0 then 'supersedes' else type end as type from (select *, round(strength * 97)::int as h from edges)),
stp as (select edge_id, src as f, dst as t, type, strength, type not in ('contradicts', 'supersedes') as conductive from te
  union all select edge_id, dst, src, type, strength, type not in ('contradicts', 'supersedes') from te where type in ('related_to', 'contradicts')),
fan as (select f, count(*) as n from stp group by 1)"""


def typed_edges(t):
    h = F.round(c("strength") * 97).cast("int")
    return b.edges(t).withColumn("type", F.when(h % 11 == 0, "contradicts").when(h % 13 == 0, "supersedes").otherwise(c("type")))


def hop_sql(hop: int, nodes: str) -> str:
    return f"""f{hop} as (select s.query_id, edge_id, stp.f as src, stp.t as dst, conductive, coalesce(x.a, 0) as tgt, {hop} as hop,
   round(greatest(0, least(1, case when type = 'contradicts' then base * abs(s.a - coalesce(x.a, 0)) when type = 'supersedes' then base * (1 - coalesce(x.a, 0)) else base end)), 12) as act
  from (select query_id, node, a from {nodes}) s join stp on stp.f = s.node join fan on fan.f = stp.f left join {nodes} x on x.query_id = s.query_id and x.node = stp.t, lateral (select greatest(0, least(1, s.a * strength * pow(0.7, {hop}) / (1 + ln(n)))) as base)),
n{hop} as (select coalesce(o.query_id, g.query_id) as query_id, coalesce(o.node, g.dst) as node, coalesce(g.act, o.a) as a from {nodes} o full join (select query_id, dst, max(act) as act from f{hop} where act >= 0.02 and conductive and act > tgt group by 1, 2) g on g.query_id = o.query_id and g.dst = o.node)"""


ACTIVATION = f"""n0 as (select n_nationkey as query_id, 'r' || n_regionkey as node, 0.9::double as a from nation where n_nationkey % 4 = 0 union all select n_nationkey, 'n' || n_nationkey, 0.6 from nation where n_nationkey % 4 = 0),
{hop_sql(1, 'n0')}, {hop_sql(2, 'n1')}"""


def activation(t):
    n = t.nation.where("n_nationkey % 4 = 0")
    seeds = n.select(c("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("r"), "n_regionkey").alias("node"), F.lit(0.9).alias("activation")).unionByName(
        n.select(c("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit(0.6).alias("activation"))
    )
    return tp.spread_activation(seeds, typed_edges(t), hops=2)


@query("g1_spreading_activation", b.cte(b.EDGES, TYPED, ACTIVATION) + "select query_id, node, round(a, 9) as activation from n2")
def g1(t):
    nodes, _ = activation(t)
    return nodes.select("query_id", "node", F.round("activation", 9).alias("activation"))


@query("g1_edge_activation", b.cte(b.EDGES, TYPED, ACTIVATION) + "select query_id, edge_id, round(max(act), 9) as activation from (select * from f1 union all select * from f2) where act >= 0.02 group by 1, 2")
def g1_edges(t):
    _, edges = activation(t)
    return edges.select("query_id", "edge_id", F.round("activation", 9).alias("activation"))


@query("g2_strength_update", b.cte(b.TRACES, """
o as (select session as edge, row_number() over (partition by session order by ts, event_id) as i, 0.05 * (case when value > 20 then 1 else 0 end - least(1, k / 50.0)) * 0.8 as d from traces),
r as (select edge, 0::bigint as i, 0.2::double as s from (select distinct edge from o) union all select r.edge, r.i + 1, greatest(0, least(1, r.s + o.d)) from r join o on o.edge = r.edge and o.i = r.i + 1)""").replace("with ", "with recursive ", 1) + """
select edge, max(i) as updates, round(arg_max(s, i), 6) as strength from r group by 1""")
def g2(t):
    rows = b.traces(t).select(
        c("session").alias("edge"), c("ts").alias("time"), c("event_id").alias("tie"), F.to_date("ts").alias("bucket"), F.when(c("value") > 20, 1.0).otherwise(0.0).alias("outcome"),
        (c("k") / 50).alias("predicted"), F.lit(0.8).alias("coactivation"),
    )
    return tp.strength_updates(rows, 0.2).select("edge", big("updates"), r6("strength"))


@query("g3_association_edges", b.cte(SL, """
nd as (select query_id, node, min(position) as position from sl where position <= 20 group by 1, 2),
p as (select x.query_id, x.position as i, y.position as j, least(x.node, y.node) as a, greatest(x.node, y.node) as b from nd x join nd y on x.query_id = y.query_id and x.position < y.position)""") + """
select * from (select query_id, a, b, row_number() over (partition by query_id order by i, j) as rank from p where (a + b) % 3 <> 0) where rank <= 6""")
def g3(t):
    nodes = shortlist(t).where("position <= 20").groupBy("query_id", "node").agg(F.min("position").alias("position"))
    labels = t.embeddings.select("label").distinct()
    stored = labels.select(c("label").alias("a")).join(labels.select(c("label").alias("b")), (c("a") <= c("b")) & ((c("a") + c("b")) % 3 == 0))
    return tp.association_edges(nodes, stored, 6).select("query_id", "a", "b", big("rank"))


@query("g4_hop_expansions", b.cte(b.EDGES, """
sd as (select s_suppkey as query_id, 's' || s_suppkey as node from supplier where s_suppkey % 5 = 0),
h1 as (select query_id, edge_id, case when src = node then dst else src end as target, node as source from sd join edges on node in (src, dst)),
fr as (select distinct query_id, target as node from h1 where (query_id, target) not in (select query_id, node from sd)),
h2 as (select query_id, edge_id, arg_min(case when src = node then dst else src end, case when src = node then 0 else 1 end) as target, arg_min(node, case when src = node then 0 else 1 end) as source
  from fr join edges on node in (src, dst) where (query_id, edge_id) not in (select query_id, edge_id from h1) group by 1, 2),
h as (select query_id, edge_id, source, target, 1 as hop from h1 union all select query_id, edge_id, source, target, 2 from h2)""") + """
select query_id, edge_id, source, target, hop from (select *, row_number() over (partition by query_id order by hop, edge_id) as r from h) where r <= 128""")
def g4(t):
    return tp.hop_expansions(graph_seeds(t), b.edges(t), 2, most_relations=128).select("query_id", "edge_id", "source", "target", "hop")


COMPONENTS = """pr as (select distinct user_id as a, 100000 + (user_id // 7) * 100 + k % 3 as b from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
un as (select a, b from pr union select b, a from pr),
rc as (select a as node, a as label from un union select un.b, rc.label from rc join un on un.a = rc.node where rc.label < un.b or true)"""


@query("g5_components", b.cte(COMPONENTS).replace("with ", "with recursive ", 1) + "select node, min(label) as component from rc group by 1")
def g5(t):
    pairs = b.traces(t).select(c("session").alias("a"), (100000 + F.floor(c("session") / 7) * 100 + c("k") % 3).alias("b")).distinct()
    return tp.connected_components(pairs)


@query("g6_key_canonicalisation", b.cte("""v as (select vec_id as id, embedding::double[] as e, label from embeddings),
pr as (select x.id as a, y.id as b from v x join v y on x.label = y.label and x.id < y.id where list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.45),
un as (select a, b from pr union select b, a from pr), rc as (select a as node, a as label from un union select un.b, rc.label from rc join un on un.a = rc.node)""").replace("with ", "with recursive ", 1) + """
select v.id, coalesce(min(rc.label), v.id) as canonical from v left join rc on rc.node = v.id group by v.id""")
def g6(t):
    """Keys of one subject that embed alike become one cluster, named by its smallest member."""
    vectors = t.embeddings.select(c("vec_id").alias("id"), "embedding", "label")
    forest = cut_lineage(tp.similarity_forest(vectors, "label", 0.45))  # it is read three times
    named = tp.connected_components(forest)
    # sorted on both sides: names that look small would be gathered in the driver
    return vectors.select("id").join(named.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("canonical"))


@query("g7_cell_probing", b.cte(b.VECTORS, VEC_SCORES.format(k=10)) + """
select q as quarters, count(*) as wanted, true as above_share from vtop, range(1, 5) as r(q) group by 1""")
def g7(t):
    """Exact top ten reached as one, two, three and all quarters of the leaves are probed, nearest first."""
    found = cl.build(b.vector_corpus(t), leaf=50)
    exact = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 10).select("query_id", "id")
    order = cl.routes(found, b.vector_queries(t), len(found.coarse), found.leaf_count).select("query_id", "cell", "leaf", "probe")
    reached = exact.join(found.placed.select("id", "cell", "leaf"), "id").join(order, ["query_id", "cell", "leaf"])
    quarters = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3, 4)]))
    share = F.count_if(c("probe") <= F.ceil(c("quarters") * found.leaf_count / 4)) / F.count("*")
    return reached.select("probe", quarters.alias("quarters")).groupBy("quarters").agg(F.count("*").alias("wanted"), (share >= F.max("quarters") / 4 - 1e-9).alias("above_share"))


@query("g8_centroid_rerank", b.cte(SL, """
ce as (select label as node, list(x order by p) as centroid from (select label, u.p, avg(ce[u.p]) as x from cv, range(1, 65) as u(p) group by 1, 2) group by 1),
sc as (select query_id, id, round(1.0::double / (60 + position) + 0.25 * list_dot_product(qe, centroid) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(centroid, centroid))), 9) as score from sl join qv using (query_id) join ce on ce.node = sl.node)""") + """
select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 20""")
def g8(t):
    centroids = tp.group_centroids(b.vector_corpus(t), "label").withColumnRenamed("label", "node")
    q = b.vector_queries(t).select("query_id", c("embedding").alias("q"))
    s = shortlist(t).select("query_id", "id", "node", "position").join(centroids, "node").join(q, "query_id")
    score = F.round(1 / (60 + c("position")) + 0.25 * vx.cosine(vx.as_double(c("q")), c("centroid")), 9)
    return lexical.top_k(s.select("query_id", "id", score.alias("score")), "score", 20).select("query_id", "id", "score", big("rank"))


@query("g9_relevance_feedback", b.cte(b.RECORDS, b.QUERIES, BM25, bm_top(3), f"""
fw as (select query_id, u.w, count(*) as n from top join records using (id), unnest([w for w in regexp_extract_all(strip_accents(lower(statement)), '[\\p{{L}}\\p{{N}}]+') if length(w) >= 5]) as u(w) where (query_id, u.w) not in (select query_id, term from qt) group by 1, 2),
ft as (select query_id, w as term from (select *, row_number() over (partition by query_id order by n desc, w) as r from fw) where r <= 10),
b2 as (select query_id, tf.id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as bm25 from ft join tf using (term) join dfs using (term) join dl on dl.id = tf.id, st group by 1, 2),
al as (select query_id, id, max(bm25) as score from (select * from bm union all select * from b2) group by 1, 2)""") + """
select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from al) where rank <= 10""")
def g9(t):
    """Frequent long words of the three best hits form a second query; best score of both wins."""
    queries = b.queries(t).select("query_id", "query")
    records = corpus(t)
    # both are used more than once, and either reads every text
    first = cut_lineage(lexical.bm25_scores(queries, records))
    feedback = cut_lineage(lexical.feedback_queries(queries, lexical.top_k(first, "bm25", 3), records, 10, 5))
    second = lexical.bm25_scores(feedback, records)
    merged = first.unionByName(second).groupBy("query_id", "id").agg(F.max("bm25").alias("score"))
    return lexical.top_k(merged, "score", 10).select("query_id", "id", big("rank"))


@query("g10_reverse_retrieval", b.cte(b.VECTORS, VEC_SCORES.format(k=20), """
t1 as (select query_id, ce as pe from vtop join cv using (id) where rank = 1),
rs as (select query_id, id, round(list_dot_product(pe, ce) / (sqrt(list_dot_product(pe, pe)) * sqrt(list_dot_product(ce, ce))), 6) as s from t1, cv),
rt as (select * from (select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank from rs where s > 0) where rank <= 20),
rf as (select query_id, id, round(sum(w / (60 + rank)), 9) as score, min(rank) as best from (select query_id, id, rank, 1.5::double as w from vtop union all select query_id, id, rank, 1.0 from rt) group by 1, 2)""") + """
select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, best, id) as rank from rf) where rank <= 20""")
def g10(t):
    direct, reverse = reverse_routes(t)
    route = lambda df, n, w: df.select("query_id", "id", F.lit(n).alias("route"), c("rank").alias("position"), F.lit(w).alias("weight"))
    return fuse.reciprocal_rank_fusion(route(direct, 1, 1.5).unionByName(route(reverse, 2, 1.0)), 20).select("query_id", "id", "score", big("rank"))


def reverse_routes(t):
    direct = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 20)
    probe = direct.where("rank = 1").join(b.vector_corpus(t).select("id", "embedding"), "id").select("query_id", "embedding")
    return direct, dense.vector_top_k(b.vector_corpus(t), probe, 20)


@query("g11_attention_pooling")
def g11(t):
    top = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 30).join(b.vector_corpus(t).select("id", "embedding"), "id")
    q = b.vector_queries(t).select("query_id", c("embedding").alias("q"), "label")
    page = top.where("rank <= 15").join(q, "query_id").select("query_id", "id", "embedding", "q")
    around = top.where("rank > 15").select("query_id", "id", "embedding")
    centroids = tp.group_centroids(b.vector_corpus(t), "label")
    zero = F.array_repeat(F.lit(0.0), 64)
    state = q.join(centroids, "label").select("query_id", zero.alias("h1"), c("centroid").alias("h2"), c("centroid").alias("h3"))
    out = ml.attention_pool(page, around, state)
    return lexical.top_k(out.withColumn("score", F.round("score", 6)), "score", 10).select("query_id", "id", "score", big("rank"))


@query("g12_fuzzy_logic", b.cte("""a as (select (select embedding::double[] from embeddings where vec_id = 0) as a0, (select embedding::double[] from embeddings where vec_id = 50) as a1, (select embedding::double[] from embeddings where vec_id = 100) as a2),
s as (select vec_id as id, [1 / (1 + exp(-4 * list_dot_product(x, embedding::double[]) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))))) for x in [a0, a1, a2]] as p from embeddings, a where vec_id not in (0, 50, 100)),
l as (select id, round(p[1] * (p[2] + (1 - p[3]) - p[2] * (1 - p[3])), 9) as combined, round((p[1] + p[2] - p[1] * p[2]) * (1 - p[1] * p[2]), 9) as exclusive from s)""") + """
select * from (select id, combined, exclusive, row_number() over (order by combined desc, id) as rank from l) where rank <= 25""")
def g12(t):
    """a AND (b OR NOT c), and a XOR b, as algebra over one membership column per atom."""
    from keelson.operators import logic

    atoms = t.embeddings.where("vec_id in (0, 50, 100)").agg(*[F.max(F.when(c("vec_id") == i, c("embedding"))).alias(f"q{n}") for n, i in enumerate((0, 50, 100))])
    rows = t.embeddings.where("vec_id not in (0, 50, 100)").select(c("vec_id").alias("id"), "embedding").crossJoin(atoms)  # one row of atoms
    a, b_, d = (logic.membership(c("embedding"), c(f"q{n}"), 4.0) for n in range(3))
    scored = rows.select("id", F.round(logic.both(a, logic.either(b_, logic.negate(d))), 9).alias("combined"), F.round(logic.exclusive(a, b_), 9).alias("exclusive"))
    top = scored.orderBy(F.desc("combined"), "id").limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "id")).cast("bigint"))  # 25 rows


@query("g13_gated_traversal")
def g13(t):
    """Greedy walk from each query over its shortlist, and the change a hypothetical record makes."""
    from keelson.operators import logic

    page = dense.vector_top_k(b.vector_corpus(t), b.vector_queries(t), 20).join(b.vector_corpus(t).select("id", "embedding"), "id")
    q = b.vector_queries(t).select("query_id", c("embedding").alias("q"))
    base = logic.traverse(page.where("id % 7 <> 3").select("query_id", "id", "embedding"), q, 4)
    more = logic.traverse(page.select("query_id", "id", "embedding"), q, 4)
    return logic.what_if(base, more).select("query_id", "id", r6("score_before"), r6("score_after"), "path_change")


@query("g14_pair_examples", b.cte(SL) + "select query_id, count(*) as positives, least(4, 40 - count(*)) * count(*) as pairs from sl where node = qlabel group by 1")
def g14(t):
    rows = shortlist(t).withColumn("label", F.when(c("node") == c("qlabel"), 1).otherwise(0))
    positives = rows.where("label = 1").groupBy("query_id").agg(F.count("*").alias("positives"))
    pairs = ml.pair_examples(rows, "label", cap=4).groupBy("query_id").agg(F.count("*").alias("pairs"))
    return positives.join(pairs, "query_id", "left").fillna({"pairs": 0})  # a page of positives only has no pair


W7_SQL = b.cte(b.RECORDS, b.QUERIES, TEXT_CANDIDATES, r"""
tk as (select *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) as qt, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as st, greatest(0, lexical) * 0.5 + greatest(0, vector) * 0.35 + greatest(0, route) * 0.15 as raw from tc),
hs as (select *, list_intersect(qt, st) as hit, count(*) over w as n, avg(raw) over w as mean, stddev_pop(raw) over w as sd, max(raw) over w as top from tk window w as (partition by query_id)),
df as (select query_id, u.t, count(*) as df from hs, unnest(hit) as u(t) group by 1, 2), qq as (select distinct query_id, n, u.t from hs, unnest(qt) as u(t)),
idf as (select qq.query_id, qq.t, ln(1 + n / coalesce(df, 0.5)) as idf from qq left join df on df.query_id = qq.query_id and df.t = qq.t), al as (select query_id, sum(idf) as total from idf group by 1),
gt as (select hs.query_id, hs.id, sum(idf) as got from hs, unnest(hit) as u(t) join idf on idf.query_id = hs.query_id and idf.t = u.t group by 1, 2)""")


@query("w7_relevance_features", W7_SQL + """
select hs.query_id, hs.id, round(ln(1 + raw), 6) as raw_log, round((raw - mean) / sd, 6) as rel_z, round(raw / top, 6) as rel_ratio, round((position - 1) / (n - 1.0::double), 6) as rank_norm, round(len(hit) / len(qt)::double, 6) as term_coverage,
  round(len(hit) / (len(qt) + len(st) - len(hit))::double, 6) as jaccard, round(coalesce(got, 0) / total, 6) as idf_coverage, round(ln(1 + length(text)) / 10, 6) as stmt_len from hs join al on al.query_id = hs.query_id left join gt on gt.query_id = hs.query_id and gt.id = hs.id""")
def w7(t):
    f = features(t)
    six = ("raw_log", "rel_z", "rel_ratio", "rank_norm", "term_coverage", "jaccard", "idf_coverage", "stmt_len")
    return f.select("query_id", "id", *[r6(x) for x in six])


def features(t):
    rows = text_candidates(t).withColumn("event_time", F.lit(None).cast("date")).withColumn("confidence", F.lit(None).cast("double"))
    return ml.relevance_features(rows, F.to_date(F.lit("2024-02-01")))


def labelled(t):
    """Shortlist with the label a scorer learns; kept, because training and scoring read it several times."""
    rows = shortlist(t).withColumn("label", F.when(c("node") == c("qlabel"), 1.0).otherwise(0.0))
    return cut_lineage(rows.withColumn("lexical", c("bm25")).withColumn("vector", c("cosine")))


MODEL_COLUMNS = ["lexical", "vector", "route", "score"]


@query("g15_relevance_scorer")
def g15(t):
    """Scorer trained on even queries, evaluated on odd ones."""
    rows = labelled(t)
    model = ml.train_scorer(rows.where("query_id % 100 = 0"), "label", MODEL_COLUMNS)
    scored = ml.score_rows(model, rows.where("query_id % 100 <> 0"))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), r6(F.avg("model_score"), "mean_score"))


@query("f17_learned_gate")
def f17(t):
    rows = labelled(t)
    model = ml.train_scorer(rows, "label", MODEL_COLUMNS)
    kept = ml.learned_gate(ml.score_rows(model, rows), 0.1)
    return ml.learned_rerank(kept).where("model_rank <= 10").select("query_id", "id", big("model_rank"))


@query("g16_rerank_evaluation")
def g16(t):
    """Recall and precision at 5 of the baseline order and the learned order on held-out queries."""
    rows = labelled(t)
    model = ml.train_scorer(rows.where("query_id % 100 = 0"), "label", MODEL_COLUMNS)
    ranked = ml.learned_rerank(ml.score_rows(model, rows.where("query_id % 100 <> 0")))
    hit = lambda r: F.count_if((c(r) <= 5) & (c("label") == 1))
    per = ranked.groupBy("query_id").agg(F.sum("label").alias("wanted"), hit("position").alias("base"), hit("model_rank").alias("learned")).where("wanted > 0")
    return per.agg(
        F.count("*").alias("queries"), r6(F.avg(c("base") / c("wanted")), "base_recall"), r6(F.avg(c("learned") / c("wanted")), "learned_recall"),
        r6(F.avg(c("base") / 5), "base_precision"), r6(F.avg(c("learned") / 5), "learned_precision"),
    )


@query("g17_decision_features", b.cte(b.TRACES) + """
select event_id as id, round(case when k % 10 = 0 then 0 else k / 100.0 end + least(k, 32) / 32.0 + case when k % 6 = 0 then 0 else greatest(-1, value / 100) end, 6) as total, (case when k % 10 = 0 then 1 else 0 end + case when k % 6 = 0 then 1 else 0 end + 13)::bigint as missing,
  (case when k % 6 <> 0 and value / 100 > 1 then 1 else 0 end)::bigint as violations from traces""")
def g17(t):
    k = c("k")
    given = {"contextOccupancy": F.when(k % 10 != 0, k / 100), "candidateCount": k, "previousReward": F.when(k % 6 != 0, c("value") / 100)}
    rows = b.traces(t).select(c("event_id").alias("id"), *[given.get(x, F.lit(None).cast("double")).alias(x) for x in ml.CONTEXT_KEYS])
    f = ml.context_features(rows)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    return f.select("id", F.round(total("values"), 6).alias("total"), total("missing").cast("bigint").alias("missing"), F.size("violations").cast("bigint").alias("violations"))


@query("g18_mention_scores")
def g18(t):
    """Context of every mention against its page's first mention, by hashed lexical embedding."""
    word = F.regexp_extract(F.lower("text"), r"([\p{L}]{3,})", 1)
    pages = t.conversations.select((c("conv_id") * 1000 + c("turn")).alias("page"), F.lower("text").alias("body"), word.alias("name")).where("name <> ''")
    return dense.mention_scores(pages, radius=240)


@query("g19_boundary_leaves", "select label as region, count(*) as members, ceil(count(*) / 25.0)::bigint as leaves, true as replicas_elsewhere from embeddings group by 1")
def g19(t):
    """ceil(n / 25) leaves in every region; a record near the border of its leaf is in a second one of the region too."""
    leaves = cl.region_leaves(t.embeddings.select(c("vec_id").alias("id"), "embedding", c("label").alias("region")), "region", 25, 0.9)
    both = leaves.groupBy("region", "id").agg(F.count("*").alias("n"), F.count_distinct("leaf").alias("d"), F.count_if(~c("replica")).alias("own"))
    whole = both.groupBy("region").agg(F.sum("own").alias("members"), F.bool_and((c("n") == c("d")) & (c("own") == 1)).alias("replicas_elsewhere"))
    return whole.join(leaves.where("not replica").groupBy("region").agg(F.count_distinct("leaf").alias("leaves")), "region")


@query("g20_weighted_probe", b.cte(b.VECTORS, VEC_SCORES.format(k=20), """
an as (select query_id, greatest(0, cosine) + 1e-6 as w, ce from vtop join cv using (id) where rank <= 3),
mv as (select query_id, list(x order by p) as pe from (select query_id, u.p, sum(w * ce[u.p]) / sum(w) as x from an, range(1, 65) as u(p) group by 1, 2) group by 1),
ps as (select query_id, id, round(list_dot_product(pe, ce) / (sqrt(list_dot_product(pe, pe)) * sqrt(list_dot_product(ce, ce))), 6) as s from mv, cv),
pt as (select * from (select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank from ps where s > 0) where rank <= 20),
t1 as (select query_id, ce as te from vtop join cv using (id) where rank = 1), rs as (select query_id, id, round(list_dot_product(te, ce) / (sqrt(list_dot_product(te, te)) * sqrt(list_dot_product(ce, ce))), 6) as s from t1, cv),
rt as (select * from (select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank from rs where s > 0) where rank <= 20),
rf as (select query_id, id, round(sum(w / (60 + rank)), 9) as score, min(rank) as best from (select query_id, id, rank, 1.5::double as w from vtop union all select query_id, id, rank, 1.0 from rt union all select query_id, id, rank, 1.0 from pt) group by 1, 2)""") + """
select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, best, id) as rank from rf) where rank <= 20""")
def g20(t):
    direct, reverse = reverse_routes(t)
    anchors = direct.where("rank <= 3").join(b.vector_corpus(t).select("id", "embedding"), "id").withColumn("w", F.greatest(F.lit(0.0), c("cosine")) + 1e-6)
    probe = tp.weighted_probe(anchors, "w")
    third = dense.vector_top_k(b.vector_corpus(t), probe, 20)
    route = lambda df, n, w: df.select("query_id", "id", F.lit(n).alias("route"), c("rank").alias("position"), F.lit(w).alias("weight"))
    routes = route(direct, 1, 1.5).unionByName(route(reverse, 2, 1.0)).unionByName(route(third, 3, 1.0))
    return fuse.reciprocal_rank_fusion(routes, 20).select("query_id", "id", "score", big("rank"))


@query("g21_training_pairs")
def g21(t):
    rows = t.documents.select("doc_id", c("lang")).join(t.labels, "doc_id").select(F.crc32("lang").alias("query_id"), c("doc_id").alias("id"), c("quality").alias("label"))
    return ml.pair_examples(rows, "label", cap=2)
