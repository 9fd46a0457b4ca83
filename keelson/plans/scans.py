"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.operators import curation, filters
from keelson.plans import bindings as b
from keelson.registry import query
from keelson.sources import loaders, sinks


@query("s1_filtered_scan", b.cte(b.RECORDS) + """
select id, node, lang, tier from records
where lang = 'en' and node <> 'src3' and contains(statement, 'the') and id > 100
order by id limit 200""")
def s1(t):
    return (
        b.records(t).where("lang = 'en' and node <> 'src3' and contains(statement, 'the') and id > 100")
        .select("id", "node", "lang", "tier").orderBy("id").limit(200)
    )


ENTITIES = """ents as (select o_orderkey as id, case o_orderstatus when 'F' then 'history' when 'O' then 'memory' else 'link' end as kind, 'c' || (o_custkey % 50) as node, 'k' || (o_orderkey % 9) as state_key,
  case when o_orderkey % 11 = 0 then null else 's' || (o_orderkey % 4) end as scope, case when o_orderkey % 3 = 0 then '' else 'u' || (o_custkey % 6) end as session, 'c' || (o_custkey % 50) as source, 'p' || (o_orderkey % 20) as target, o_orderdate as event_time from orders)"""


def entities(t):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "F", "history").when(F.col("o_orderstatus") == "O", "memory").otherwise("link").alias("kind"),
        F.concat(F.lit("c"), cust % 50).alias("node"), F.concat(F.lit("k"), k % 9).alias("state_key"), F.when(k % 11 != 0, F.concat(F.lit("s"), k % 4)).alias("scope"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("u"), cust % 6)).alias("session"), F.concat(F.lit("c"), cust % 50).alias("source"), F.concat(F.lit("p"), k % 20).alias("target"), F.col("o_orderdate").alias("event_time"),
    )


@query("s1_entity_filters", b.cte(ENTITIES) + """
select 'scope' as scan, id from ents where kind = 'history' and scope = 's1' and (session = '' or session = 'u2') and state_key = 'k4'
union all select 'window', id from ents where kind = 'memory' and scope <> 's1' and event_time >= timestamp '1995-01-01' and event_time <= timestamp '1996-06-30' and node in ('c3', 'c4')
union all select 'edges', id from ents where source = 'c7' or target = 'c7' or source = 'p7' or target = 'p7'""")
def s1_filters(t):
    e = entities(t)
    stamp = lambda x: F.expr(f"timestamp_ntz'{x} 00:00:00'")
    scans = {
        "scope": filters.entity_filter(kind="history", scope="s1", session="u2", session_scoped=True, state_key="k4"),
        "window": filters.entity_filter(kind="memory", exclude_scope="s1", event_from=stamp("1995-01-01"), event_to=stamp("1996-06-30"), nodes=["c3", "c4"]),
        "edges": filters.entity_filter(connected_to="c7") | filters.entity_filter(connected_to="p7"),
    }
    parts = [e.where(condition).select(F.lit(name).alias("scan"), "id") for name, condition in scans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s1_keyset_page", b.cte(ENTITIES) + """
select id, node, event_time from ents where (event_time, id) > (timestamp '1995-03-01', 100) order by event_time, id limit 200""")
def s1_page(t):
    rows = entities(t).select("id", "node", "event_time")
    return filters.keyset_page(rows, ["event_time", "id"], (F.expr("timestamp_ntz'1995-03-01 00:00:00'"), F.lit(100)), 200)


@query("s2_multi_query_scan", b.cte(b.RECORDS) + """
select item_id as slot, id, tier from benchmark
join records on node = 'src' || (item_id % 20) and tier >= item_id % 4""")
def s2(t):
    slots = t.benchmark.select(
        F.col("item_id").alias("slot"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("node"),
        (F.col("item_id") % 4).alias("min_tier"),
    )
    # The query side is the small one; Catalyst broadcasts it by its file size.
    return b.records(t).select("id", "node", "tier").join(slots, "node").where("tier >= min_tier").select("slot", "id", "tier")


@query("s3_conversation_turns", """
select conv_id, turn, case when role in ('assistant', 'system') then role else 'user' end as role,
  length(text) as chars from conversations""")
def s3(t):
    """Round trip through the nested dataset form: each row becomes JSON and is exploded back."""
    turn = F.struct(
        F.col("role"), F.lit(None).cast("string").alias("speaker"), F.col("text").alias("content"),
        F.col("turn").cast("string").alias("sourceId"),
    )
    case = F.struct(
        F.col("conv_id").cast("string").alias("id"),
        F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.array(turn).alias("turns"))).alias("sessions"),
    )
    cases = t.conversations.select(F.from_json(F.to_json(case), loaders.CASE_SCHEMA).alias("c")).select("c.*")
    return loaders.case_turns(cases).select(
        F.col("session").cast("bigint").alias("conv_id"), F.col("source_id").cast("bigint").alias("turn"), "role",
        F.length("content").alias("chars"),
    )


@query("s4_pinned_sample", """
with s as (select item_id, text from benchmark order by item_id limit 25)
select item_id, length(text) as chars,
  (select sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) from s) as digest from s""")
def s4(t):
    return loaders.pinned_sample(t.benchmark, "item_id", 25).select("item_id", F.length("text").alias("chars"), "digest")


def event_lines(t):
    """Events as JSON lines; every 17th line is cut short and every 11th has another version."""
    body = F.to_json(F.struct(
        F.when(F.col("event_id") % 11 == 0, 9).otherwise(F.col("event_id") % 2 + 1).cast("int").alias("version"),
        F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("graphId"),
        F.col("user_id").alias("sessionId"), F.col("ts").alias("recordedAt"), "value",
    ))
    line = F.when(F.col("event_id") % 17 == 0, F.expr("left(body, 20)")).otherwise(F.col("body"))
    return t.events.withColumn("body", body).select(line.alias("value"))


@query("s5_event_log", """
select event_type as type, count(*) as events, count(distinct user_id) as sessions, round(sum(value), 4) as total
from events where event_id % 17 <> 0 and event_id % 11 <> 0 group by 1""")
def s5(t):
    good, _ = loaders.parse_event_log(event_lines(t))
    return good.groupBy("type").agg(
        F.count("*").alias("events"), F.countDistinct("sessionId").alias("sessions"), F.round(F.sum("value"), 4).alias("total")
    )


@query("s5_event_log_quarantine", """
select case when event_id % 17 = 0 then 'malformed' else 'version' end as problem, count(*) as lines
from events where event_id % 17 = 0 or event_id % 11 = 0 group by 1""")
def s5_quarantine(t):
    _, bad = loaders.parse_event_log(event_lines(t))
    return bad.groupBy(F.when(F.col("value").endswith("}"), "version").otherwise("malformed").alias("problem")).agg(
        F.count("*").alias("lines")
    )


@query("s6_entity_mentions", r"""
with w as (select doc_id, doc_id % 13 <> 0 as valid, unnest(string_split(coalesce(text, ''), ' ')) as word from documents),
m as (select doc_id, valid, count(*) filter (regexp_matches(word, '^[A-Z0-9]')) as mentions, sum(case when regexp_matches(word, '^[A-Z0-9]') then length(word) else 0 end) as chars from w group by 1, 2)
select valid, count(*) as pages, sum(case when valid then mentions else 0 end)::bigint as mentions, sum(case when valid then chars else 0 end)::bigint as chars from m where doc_id in (select doc_id from documents where text is not null) group by 1""")
def s6(t):
    """Every word that begins with a capital or digit is a mention, with its span in the text; one page in
    thirteen has mentions without an end. Spans are read back from the text."""
    docs = t.documents.where("text is not null").select("doc_id", "source", "text")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    before = F.sum(F.length("word") + 1).over(Window.partitionBy("doc_id").orderBy("place")) - F.length("word") - 1
    start = before.cast("int").alias("start")
    spans = words.select("doc_id", "place", "word", start).where(F.col("word").rlike("^[A-Z0-9]")).select(
        "doc_id", F.struct("start", F.col("word").alias("text"), F.when(F.col("doc_id") % 13 != 0, F.col("start") + F.length("word")).alias("end"), F.lit("Same").alias("tag")).alias("e")
    ).groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("entities"))
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("text"), F.when(F.col("doc_id") % 13 != 0, 0).alias("end"), F.lit("Same").alias("tag")))
    lines = docs.join(spans, "doc_id", "left").select(F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("pageid"), F.col("source").alias("title"), "text", F.coalesce("entities", none).alias("entities")
    )).alias("value"))
    good, bad = loaders.parse_mentions(lines)
    real = F.filter("entities", lambda e: (e["text"] != "") & (F.substr(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["text"]))
    counted = good.select(F.lit(True).alias("valid"), F.size(real).alias("n"), F.aggregate(real, F.lit(0), lambda a, e: a + e["end"] - e["start"]).alias("c"))
    flagged = counted.unionByName(bad.select(F.lit(False).alias("valid"), F.lit(0).alias("n"), F.lit(0).alias("c")))
    return flagged.groupBy("valid").agg(F.count("*").alias("pages"), F.sum("n").alias("mentions"), F.sum("c").alias("chars"))


@query("s7_export_bundle", b.cte(b.TURNS, """
m as (select session, ordinal, role from turns where role <> 'system'),
e as (select m.session, m.ordinal, string_agg(ev.content, '|' order by ev.ordinal) as joined, count(*) as n
  from m join turns ev on ev.session = m.session and ev.ordinal between m.ordinal - 1 and m.ordinal group by 1, 2),
n as (select session, count(*) as node_turns from turns group by 1)""") + """
select m.session * 1000 + m.ordinal as id, m.role as source_actor, n.node_turns, e.n as evidence_count, md5(e.joined) as digest
from m join n using (session) left join e using (session, ordinal)""")
def s7(t):
    turns = b.turns(t)
    key = F.col("session") * 1000 + F.col("ordinal")
    memories = turns.where("role <> 'system'").select(
        key.alias("id"), F.col("session").alias("node"), F.col("role").alias("source_actor"), F.lit("active").alias("status"),
        F.col("ordinal").alias("created_at"), F.array(key - 1, key).alias("evidence_ids"),
    )
    evidence = turns.select(key.alias("evidence_id"), "content")
    nodes = turns.groupBy(F.col("session").alias("node")).agg(F.count("*").alias("node_turns"))
    bundle = sinks.export_bundle(memories, nodes, evidence, None, False)
    return bundle.select(
        "id", "source_actor", "node_turns", F.size("evidence").cast("bigint").alias("evidence_count"),
        F.md5(F.array_join("evidence", "|")).alias("digest"),
    )


@query("s8_import_violations", b.cte(b.EDGES) + """
select 'missing_source' as rule, edge_id as id from edges where src not in (select 'n' || n_nationkey from nation where n_nationkey % 5 <> 0 union all select 'r' || r_regionkey from region)
union all
select 'missing_target', edge_id from edges where dst like 'c%' and dst not in (select 'c' || c_custkey from customer where c_custkey % 7 <> 0)
union all
select 'missing_evidence', l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 <> 0)
union all
select 'cross_session_evidence', l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 3 <> 0 and l_shipdate < o_orderdate""")
def s8(t):
    edges = b.edges(t)
    nodes = (
        t.nation.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
        .unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node")))
        .unionByName(t.customer.where("c_custkey % 7 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")))
        .unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    )
    sources = nodes.where("substr(node, 1, 1) in ('n', 'r')")
    line_id = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id")
    links = t.lineitem.select(line_id, F.col("l_orderkey").alias("evidence_id"), F.col("l_shipdate").alias("scope_time"))
    evidence = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("evidence_time"))
    return curation.import_violations(
        edges.where("src not like 's%'"), sources, edges.where("dst like 'c%'"), nodes, links, evidence
    )


@query("s9_idempotent_upsert", """
with batch as (select doc_id as key, doc_id % 50 as op, sha256(lang) as h, n_chars as payload from documents where doc_id % 3 = 0),
receipts as (select distinct op, case when op % 4 = 0 then sha256('en') else sha256('?') end as h from batch where op % 2 = 0),
fresh as (select * from batch where op not in (select op from receipts))
select coalesce(e.key, f.key) as key, coalesce(f.payload, e.payload) as payload,
  (case when e.key is null then 0 else 1 end + case when f.key is null then 0 else 1 end)::bigint as revision
from (select doc_id as key, 0::bigint as payload from documents where doc_id % 2 = 0) e full join fresh f on e.key = f.key""")
def s9(t):
    existing = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("payload"), F.lit(1).cast("bigint").alias("revision"))
    batch, receipts = upsert_batch(t)
    merged, _ = sinks.plan_upsert(existing, batch, receipts)
    return merged


def upsert_batch(t):
    batch = t.documents.where("doc_id % 3 = 0").select(
        F.col("doc_id").alias("key"), (F.col("doc_id") % 50).alias("operation_id"), F.sha2("lang", 256).alias("request_hash"),
        F.col("doc_id").alias("slot"), F.col("n_chars").alias("payload"),
    )
    receipts = batch.where("operation_id % 2 = 0").select("operation_id").distinct().withColumn(
        "request_hash", F.sha2(F.when(F.col("operation_id") % 4 == 0, "en").otherwise("?"), 256)
    )
    return batch, receipts


@query("s9_upsert_conflicts", """
select doc_id as key, doc_id % 50 as operation_id from documents
where doc_id % 3 = 0 and doc_id % 50 % 2 = 0 and not (doc_id % 50 % 4 = 0 and lang = 'en')""")
def s9_conflicts(t):
    existing = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("payload"), F.lit(1).cast("bigint").alias("revision"))
    batch, receipts = upsert_batch(t)
    _, conflicts = sinks.plan_upsert(existing, batch, receipts)
    return conflicts.select("key", "operation_id")


@query("s11_policy_dataset", b.cte(b.TRACES) + """
select sha256(session::varchar) as session_hash, kind, count(*) as events, round(avg(value), 8) as mean_value,
  max(case when value > 100 then 1 else 0 end) as label,
  case when ('0x' || substr(sha256(session::varchar), 1, 8))::ubigint % 10 < 6 then 'train'
       when ('0x' || substr(sha256(session::varchar), 1, 8))::ubigint % 10 < 8 then 'validation' else 'test' end as split
from traces group by session, kind""")
def s11(t):
    observed = b.traces(t).groupBy("session", "kind").agg(
        F.count("*").alias("events"), F.round(F.avg("value"), 8).alias("mean_value"),
        F.max(F.when(F.col("value") > 100, 1).otherwise(0)).alias("label"),
    )
    return observed.select(
        F.sha2(F.col("session").cast("string"), 256).alias("session_hash"), "kind", "events", "mean_value", "label",
        sinks.hash_split(F.col("session")).alias("split"),
    )


@query("s12_shard_merge", """
select id, count(*) as copies from (
  select event_id % 5000 as id from events where event_id % 2 = 0 union all
  select event_id % 5000 from events where event_id % 2 = 1 union all select event_id from events where event_id % 7 = 0) group by 1 having count(*) > 1""")
def s12(t):
    shards = [
        t.events.where("event_id % 2 = 0").select((F.col("event_id") % 5000).alias("id")),
        t.events.where("event_id % 2 = 1").select((F.col("event_id") % 5000).alias("id")),
        t.events.where("event_id % 7 = 0").select(F.col("event_id").alias("id")),
    ]
    _, repeated = loaders.merge_shards(shards, "id")
    return repeated


@query("s13_pending_index", """
select doc_id as id, n_chars from documents where doc_id not in (select vec_id from embeddings where vec_id % 3 <> 0)
  and (n_chars, doc_id) < (4000, 100000000) order by n_chars desc, doc_id limit 150""")
def s13(t):
    stored = t.embeddings.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"))
    pending = curation.pending_index(t.documents.select(F.col("doc_id").alias("id"), "n_chars"), stored)
    return pending.where("n_chars < 4000 or (n_chars = 4000 and id < 100000000)").orderBy(F.desc("n_chars"), "id").limit(150)
