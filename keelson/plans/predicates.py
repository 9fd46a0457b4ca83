"""Filters, classifications and derived record columns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.functions import text as tx, time as tm, vocabulary as vb
from keelson.operators import curation, filters as fl, projection
from keelson.plans import bindings as b
from keelson.plans.scalars import BL, sql_statement
from keelson.registry import query
from keelson.session import explode_rows, spread
from keelson.sources import sinks

NOW = "timestamp_ntz'2000-01-01 00:00:00'"
SQL_NOW = "timestamp '2000-01-01 00:00:00'"
SQL_VISIBLE = f"""status = 'active' and not forgotten and (session is null or session = 3)
  and (expires_at is null or expires_at > {SQL_NOW}) and valid_from <= {SQL_NOW} and (valid_until is null or valid_until > {SQL_NOW})"""


@query("f1_visible", b.cte(b.MEMORIES) + f"select id, node, amount from memories where {SQL_VISIBLE}")
def f1(t):
    return b.memories(t).where(fl.visible(F.lit(3), F.expr(NOW))).select("id", "node", "amount")


@query("f2_searchable_historical", b.cte(b.MEMORIES) + f"""
select id, status from memories where storage_state is null and source_actor = 'user' and status <> 'deleted' and not forgotten
  and (session is null or session = 3) and (expires_at is null or expires_at > {SQL_NOW})""")
def f2(t):
    return b.memories(t).where(fl.searchable(F.lit(3), F.expr(NOW), historical=True, actor="user")).select("id", "status")


@query("f3_event_window", """
select event_id, value from events where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-12 12:00:00'""")
def f3(t):
    bound = lambda s: F.expr(f"timestamp_ntz'{s}'")
    return t.events.where(
        (F.col("ts") >= bound("2024-01-10 00:00:00")) & (F.col("ts") <= bound("2024-01-12 12:00:00"))
    ).select("event_id", "value")


@query("f4_scope_predicates", b.cte(b.MEMORIES) + """
select id, segment = '1' and site = '2' as exact, not (segment = '1' and site = '2') as excluded, segment = '1' as subset from memories""")
def f4(t):
    want = F.create_map(F.lit("site"), F.lit("2"), F.lit("segment"), F.lit("1"))
    part = F.create_map(F.lit("segment"), F.lit("1"))
    exact = fl.scope_key(F.col("scope")) == fl.scope_key(want)
    return b.memories(t).select("id", exact.alias("exact"), (~exact).alias("excluded"), fl.scope_matches(F.col("scope"), part).alias("subset"))


@query("f5_scope_overlap", b.cte(b.MEMORIES) + """
select id, segment = '2' as overlaps, case when segment = '2' then '{"lang":"en","segment":"2","site":"' || site || '"}' end as merged from memories""")
def f5(t):
    other = F.create_map(F.lit("segment"), F.lit("2"), F.lit("lang"), F.lit("en"))
    overlaps = fl.scopes_overlap(F.col("scope"), other)
    merged = F.map_zip_with(F.col("scope"), other, lambda k, l, r: F.coalesce(r, l))
    return b.memories(t).select("id", overlaps.alias("overlaps"), F.when(overlaps, fl.scope_key(merged)).alias("merged"))


@query("f6_session_tier", b.cte(b.RECORDS) + """
select id, tier from records where tier <= 1 and (case when id % 4 = 0 then id % 10 end is null or id % 10 = 4)""")
def f6(t):
    r = b.records(t).withColumn("session", F.when(F.col("id") % 4 == 0, F.col("id") % 10))
    return r.where((F.col("tier") <= 1) & fl.session_allows(F.lit(4))).select("id", "tier")


# Texts that contain policy wording are derived from the table so every reason occurs.
def policy_rows(t):
    k = F.col("doc_id") % 16
    tail = (
        F.when(k == 0, " password: hunter22").when(k == 1, " Bearer abcdefghijklmnop").when(k == 2, " please do not store this")
        .when(k == 3, " this is temporary wording").when(k == 4, " still pending review").when(k == 5, " the next step")
        .when(k == 6, " for this session only").otherwise("")
    )
    return spread(t.documents).select(
        F.col("doc_id").alias("id"), F.concat("text", tail).alias("statement"), F.lit(None).cast("string").alias("evidence"),
        F.when(F.col("lang") == "de", "event").otherwise("fact").alias("memory_type"), (F.col("doc_id") % 32 == 19).alias("bypass"),
        F.when(F.col("doc_id") % 32 == 20, "2030-01-01").alias("expires_at"),
    )


SQL_POLICY = r"""rows as (select doc_id as id, lang, doc_id % 32 as m, text || case doc_id % 16 when 0 then ' password: hunter22' when 1 then ' Bearer abcdefghijklmnop'
    when 2 then ' please do not store this' when 3 then ' this is temporary wording' when 4 then ' still pending review' when 5 then ' the next step'
    when 6 then ' for this session only' else '' end as s from documents),
classified as (select id, case
  when regexp_matches(s, '(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\b(?:api[_ -]?key|access[_ -]?token|auth(?:orization)?[_ -]?token|password|passwd|secret)\b\s*[:=]\s*\S+|\bBearer\s+[A-Za-z0-9._~+/=-]{12,}|\b(?:sk|pk)-(?:live|test|prod)-[A-Za-z0-9_-]{8,}\b|\bsk-[A-Za-z0-9_-]{12,}\b') then 'secret'
  when regexp_matches(s, '(?i)\b(?:do not|don''t|never)\s+(?:retain|remember|store|save)\b') then 'non_persistent_instruction'
  when lang <> 'de' and m <> 19 and regexp_matches(s, '(?i)\b(?:for )?(?:this|the current) (?:response|reply|turn|task|session) only\b|\btemporar(?:y|ily)\b') then 'non_persistent_instruction'
  when lang <> 'de' and m not in (19, 20) and regexp_matches(s, '(?i)\b(?:still )?pending (?:review|merge|push|approval|confirmation|checks?|ci|gate)\b|\b(?:the )?next step\b') then 'coordination_state'
  else 'allowed' end as reason from rows)"""


@query("f7_write_policy", b.cte(SQL_POLICY) + "select id, reason from classified")
def f7(t):
    c = F.col
    reason = curation.write_reason(c("statement"), c("evidence"), c("memory_type"), c("bypass"), c("expires_at"))
    return policy_rows(t).select("id", reason.alias("reason"))


@query("s10_write_split", b.cte(SQL_POLICY) + """
select case when reason = 'allowed' then 'accepted' else 'rejected' end as decision, reason, count(*) as rows from classified group by 1, 2""")
def s10(t):
    return sinks.split_writes(f7(t))["audit"].groupBy("decision", "reason").agg(F.count("*").alias("rows"))


@query("f8_structure_rules", """
select o_orderkey as id, concat_ws(',', case when o_orderkey % 17 = 0 then 'statement_and_node_required' end,
  case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'state_requires_key' end, case when o_orderkey % 5 = 0 and o_orderkey % 7 = 0 then 'provisional_requires_session' end,
  case when o_orderkey % 19 = 0 then 'open_requires_related' end, case when o_orderkey % 23 = 0 then 'invalid_expiry' end,
  case when o_orderkey % 29 = 0 then 'evidence_requires_message_id' end, case when o_orderkey % 31 = 0 then 'evidence_actor_mismatch' end) as violations from orders""")
def f8(t):
    k = F.col("o_orderkey")
    some = F.lit("x")
    rows = t.orders.select(
        k.alias("id"), F.when(k % 17 == 0, "  ").otherwise("text").alias("statement"), some.alias("node"),
        F.when(k % 3 == 0, "state").otherwise("fact").alias("memory_type"), F.when(k % 2 == 1, "key").alias("state_key"),
        F.when(k % 5 == 0, "stg").otherwise("ltg").alias("residence"), F.when(k % 7 != 0, "s1").alias("session_id"),
        F.when(k % 19 == 0, "open").alias("resolution"), F.array().cast("array<string>").alias("related_ids"),
        F.when(k % 23 == 0, "soon").otherwise("2030-01-01").alias("expires_at"), some.alias("evidence_content"),
        F.when(k % 29 != 0, "m1").alias("evidence_message_id"), F.when(k % 31 == 0, "tool").otherwise("user").alias("evidence_actor"),
        F.lit("user").alias("source_actor"),
    )
    return rows.select("id", F.array_join(curation.structure_violations(), ",").alias("violations"))


QLOG = """qlog as (select item_id, text, ['type:preference,fact node:src' || item_id % 20 || ' -the ', 'state:open time:2024-01-05..2024-01-20 -an -on ', 'time:2024-02 ', 'plain '][1 + item_id % 4] || text as q from benchmark)"""


def query_log(t):
    k = F.col("item_id")
    lead = F.element_at(
        F.array(
            F.concat(F.lit("type:preference,fact node:src"), (k % 20).cast("string"), F.lit(" -the ")),
            F.lit("state:open time:2024-01-05..2024-01-20 -an -on "), F.lit("time:2024-02 "), F.lit("plain "),
        ),
        (k % 4 + 1).cast("int"),
    )
    return t.benchmark.select(k.alias("query_id"), F.concat(lead, "text").alias("q"))


def advanced_columns(log):
    """Operators of a query log pulled into columns, and the remaining semantic text."""
    q = F.col("q")
    value = lambda name: F.nullif(F.regexp_extract(q, rf"(?:^|\s){name}:(\S+)", 1), F.lit(""))
    lists = lambda name: F.split(value(name), ",")
    excluded = F.transform(F.regexp_extract_all(q, F.lit(r"(?:^|\s)-([^\s:]+)"), F.lit(1)), F.lower)
    semantic = F.trim(F.regexp_replace(F.regexp_replace(q, r"(?:^|\s)(?:type|node|state|time):\S+", " "), r"(?:^|\s)-[^\s:]+", " "))
    return log.select(
        "query_id", lists("type").alias("types"), value("node").alias("node_contains"), lists("state").alias("states"),
        value("time").alias("time_text"), F.when(value("time").isNotNull(), "explicit").alias("time_source"),
        excluded.alias("exclude_terms"), semantic.alias("semantic"),
    )


@query("f10_query_operators", b.cte(QLOG) + r"""
select item_id as query_id, nullif(regexp_extract(q, '(?:^|\s)type:(\S+)', 1), '') as types, nullif(regexp_extract(q, '(?:^|\s)node:(\S+)', 1), '') as node_contains,
  nullif(regexp_extract(q, '(?:^|\s)time:(\S+)', 1), '') as time_text, array_to_string([lower(x) for x in regexp_extract_all(q, '(?:^|\s)-([^\s:]+)', 1)], ',') as excluded,
  md5(trim(regexp_replace(regexp_replace(q, '(?:^|\s)(?:type|node|state|time):\S+', ' ', 'g'), '(?:^|\s)-[^\s:]+', ' ', 'g'))) as semantic_key from qlog""")
def f10(t):
    a = advanced_columns(query_log(t))
    return a.select(
        "query_id", F.array_join("types", ",").alias("types"), "node_contains", "time_text",
        F.array_join("exclude_terms", ",").alias("excluded"), F.md5("semantic").alias("semantic_key"),
    )


@query("f9_advanced_filters", b.cte(b.RECORDS, QLOG, r"""
f as (select item_id as query_id, string_split(nullif(regexp_extract(q, '(?:^|\s)type:(\S+)', 1), ''), ',') as types, nullif(regexp_extract(q, '(?:^|\s)node:(\S+)', 1), '') as node_contains,
  [lower(x) for x in regexp_extract_all(q, '(?:^|\s)-([^\s:]+)', 1)] as excluded from qlog)""") + """
select query_id, id, row_number() over (partition by query_id order by id) as position from f join records r on r.node = 'src' || (query_id % 20)
where (types is null or list_contains(types, memory_type)) and (node_contains is null or contains(lower(node), lower(node_contains)))
  and len([x for x in excluded if contains(lower(statement || ' ' || node), x)]) = 0""")
def f9(t):
    f = advanced_columns(query_log(t)).withColumn("page", F.concat(F.lit("src"), F.col("query_id") % 20))
    r = b.records(t)
    text = F.lower(F.concat_ws(" ", "statement", "node"))
    kept = r.join(f, r["node"] == f["page"]).where(
        (F.col("types").isNull() | F.array_contains("types", F.col("memory_type")))
        & (F.col("node_contains").isNull() | F.lower("node").contains(F.lower("node_contains")))
        & ~F.exists("exclude_terms", lambda x: text.contains(x))
    )
    w = Window.partitionBy("query_id").orderBy("id")
    return kept.select("query_id", "id", F.row_number().over(w).cast("bigint").alias("position"))


F9Q = """fq as (select item_id as query_id, case when item_id % 2 = 0 then ['fact', 'event'] end as types, case when item_id % 3 = 0 then ['SRC1', 'src7'] end as names,
  case when item_id % 2 = 1 then ['k1', 'k3'] end as states, case when item_id % 4 <> 1 then timestamp '2024-01-01' + to_days((item_id % 20)::int) end as lo, case when item_id % 5 <> 2 then timestamp '2024-02-20' - to_days((item_id % 10)::int) end as hi,
  case when item_id % 3 = 1 then ['thea', 'un'] end as excluded from benchmark)"""


@query("f9_states_and_times", b.cte(b.RECORDS, F9Q, """
r as (select *, 'k' || (id % 7) as state_key, case when id % 13 <> 0 then timestamp '2024-01-01' + to_days((id % 60)::int) end as event_time from records)""") + """
select query_id, id from fq join r on r.node = 'src' || (query_id % 20)
where (types is null or list_contains(types, memory_type)) and (names is null or contains(lower(node), lower(names[1])) or contains(lower(node), lower(names[2]))) and (states is null or list_contains(states, state_key))
  and (lo is null or coalesce(event_time >= lo, false)) and (hi is null or coalesce(event_time <= hi, false)) and (excluded is null or len([x for x in excluded if contains(lower(statement || ' ' || node), x)]) = 0)""")
def f9_states(t):
    """Type, node, state and excluded-term lists and an event-time range per query, on candidates of its node."""
    q, i = F.col("item_id"), F.col("id")
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    day = lambda text, n: F.expr(f"timestamp_ntz'{text} 00:00:00'") + F.make_dt_interval(n.cast("int"))
    asked = t.benchmark.select(
        q.alias("query_id"), F.concat(F.lit("src"), q % 20).alias("page"), F.when(q % 2 == 0, words("fact", "event")).alias("types"), F.when(q % 3 == 0, words("SRC1", "src7")).alias("names"),
        F.when(q % 2 == 1, words("k1", "k3")).alias("states"), F.when(q % 4 != 1, day("2024-01-01", q % 20)).alias("lo"), F.when(q % 5 != 2, day("2024-02-20", -(q % 10))).alias("hi"),
        F.when(q % 3 == 1, words("thea", "un")).alias("excluded"),
    )
    r = b.records(t).withColumns({"state_key": F.concat(F.lit("k"), i % 7), "event_time": F.when(i % 13 != 0, day("2024-01-01", i % 60))})
    passes = fl.passes_advanced(*[F.col(x) for x in ("types", "names", "states", "lo", "hi", "excluded")])
    return r.join(asked, r["node"] == asked["page"]).where(passes).select("query_id", "id")


@query("f12_surface_hits", r"""
with q as (select item_id as query_id, lower(regexp_extract(text, '[a-zA-Z]+ [a-zA-Z]+')) as anchor from benchmark), d as (select doc_id as id, lower(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select query_id, id, anchor from q join d on contains(t, anchor) where length(anchor) >= 3""")
def f12_hits(t):
    """Records that contain the two words a query quotes."""
    from keelson.operators import lexical

    quoted = F.concat(F.lit('look for "'), F.regexp_extract("text", "[a-zA-Z]+ [a-zA-Z]+", 0), F.lit('"'))
    return lexical.surface_hits(t.benchmark.select(F.col("item_id").alias("query_id"), quoted.alias("query")), spread(t.documents).select(F.col("doc_id").alias("id"), F.col("text").alias("statement")))


@query("f11_exact_anchor", """
select doc_id as id, 'v' || doc_id % 3 || '.2' as anchor from documents where doc_id % 4 <> 0 or doc_id % 3 <> doc_id % 5 % 3""")
def f11(t):
    """Identifier lookup on token edges: v1.2 is not found inside v1.2.3."""
    from keelson.operators import lexical

    k = F.col("doc_id")
    tail = F.when(k % 4 == 0, F.concat(F.lit(" v"), k % 5 % 3, F.lit(".2.7"))).otherwise("")
    plain = F.when((k % 4 != 0) | (k % 3 != k % 5 % 3), F.concat(F.lit(" see v"), k % 3, F.lit(".2, and"))).otherwise("")
    texts = spread(t.documents).select(k.alias("id"), F.concat("text", plain, tail).alias("statement"))
    anchors = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("v"), "r_regionkey", F.lit(".2")).alias("query"))
    return lexical.exact_anchor_hits(anchors, texts).select("id", F.col("anchor"))


@query("f12_surface_anchors", rf"""
with s as (select doc_id as id, text || case doc_id % 4 when 0 then ' src/core/file' || doc_id || '.ts' when 1 then ' ERR_' || doc_id || ' raised' when 2 then ' parseHttpUrl now' else '' end as s from documents),
tok as (select id, regexp_replace(u.w, '^[,;!?()\[\]{{}}"“”''‘’`]+|[,;!?()\[\]{{}}"“”''‘’`]+$', '', 'g') as w from s, unnest(regexp_split_to_array(s, '\s+')) as u(w)),
coded as (select id, w from tok where regexp_matches(w, '[\\/:._+#@-]') or regexp_matches(w, '\p{{N}}') or regexp_matches(w, '^[A-Z][A-Z0-9_]{{2,}}$') or regexp_matches(w, '^\p{{Lu}}[\p{{L}}\p{{N}}]*\p{{Ll}}[\p{{L}}\p{{N}}]*\p{{Lu}}[\p{{L}}\p{{N}}]*$')),
quoted as (select id, u.w from s, unnest(regexp_extract_all(s, '["“”''‘’]([^"“”''‘’\r\n]+)["“”''‘’]', 1)) as u(w) union all select id, u.w from s, unnest(regexp_extract_all(s, '`([^`\r\n]+)`', 1)) as u(w)),
a as (select id, lower(trim(regexp_replace(trim(w, {BL}), '^[,;!?()\[\]{{}}]+|[,;!?()\[\]{{}}]+$', '', 'g'), {BL})) as w from (select * from coded union all select * from quoted))
select id, count(distinct w) as anchors, md5(string_agg(distinct w, ' ' order by w)) as anchor_key from a where length(w) >= 3 group by 1""")
def f12(t):
    k = F.col("doc_id")
    tail = (
        F.when(k % 4 == 0, F.concat(F.lit(" src/core/file"), k, F.lit(".ts"))).when(k % 4 == 1, F.concat(F.lit(" ERR_"), k, F.lit(" raised")))
        .when(k % 4 == 2, " parseHttpUrl now").otherwise("")
    )
    texts = spread(t.documents).select(k.alias("id"), tx.nfkc(F.concat("text", tail)).alias("s"))
    # An exploded array of one: a filter on a plain column would be pushed down and form the anchors twice.
    rows = explode_rows(texts, F.array(tx.surface_anchors(F.col("s"), unicode=False)), "a", "id").where(F.size("a") > 0)
    return rows.select("id", F.size("a").cast("bigint").alias("anchors"), F.md5(F.array_join(F.array_sort("a"), " ")).alias("anchor_key"))


@query("f13_profile_match", rf"""
with q as (select item_id, ' ' || {sql_statement('text')} || ' ' as nq from benchmark),
p as (select p_partkey, p_name from part where p_size % 2 = 0),
trig as (select p_partkey as id, p_name as phrase from p union all select p_partkey, split_part(p_name, ' ', 1) from p union all select p_partkey, 'the' from p where p_partkey % 50 = 0)
select item_id as query_id, id, max(length(phrase))::bigint as score from q join trig on contains(nq, ' ' || phrase || ' ') group by 1, 2""")
def f13(t):
    """Longest profile trigger in each query: exploded triggers meet the query's word n-grams."""
    from keelson.operators import lexical

    marker = lambda v: F.struct(F.lit("recall_trigger").alias("kind"), F.create_map(F.lit("value"), v).alias("attributes"))
    base = F.array(marker(F.col("p_name")), marker(F.substring_index("p_name", " ", 1)))
    markers = F.when(F.col("p_partkey") % 50 == 0, F.concat(base, F.array(marker(F.lit("the"))))).otherwise(base)
    profile = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), fl.recall_triggers(markers).alias("triggers"))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), tx.statement_form(F.col("text")).alias("nq"))
    return lexical.trigger_matches(queries, profile)


@query("f14_intents", r"""
with q as (select conv_id, turn, lower(['how many ', 'please recommend ', 'you said ', ''][1 + turn % 4] || text) as q from conversations)
select conv_id, turn, regexp_matches(q, '\b(?:how many|how much|list|all|count)\b') as list_count, regexp_matches(q, '\b(?:recommend|suggest|preference)\b') as recommend,
  regexp_matches(q, '\b(?:assistant|you said|previous chat)\b') as assistant from q""")
def f14(t):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("how many ", "please recommend ", "you said ", "")]), (F.col("turn") % 4 + 1).cast("int"))
    rows = t.conversations.select("conv_id", "turn", F.lower(F.concat(lead, "text")).alias("q"))
    return rows.select("conv_id", "turn", *[fl.intent(F.col("q"), f).alias(f) for f in fl.INTENTS])


def prompts(t):
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("Do you remember ", "Please suggest something: ", "上周我们决定过 ", "", "where is my ", "")]),
        (F.col("turn") % 6 + 1).cast("int"),
    )
    return t.conversations.select(F.col("conv_id").alias("session"), "turn", F.concat(lead, "text").alias("prompt"))


@query("f15_recall_need", r"""
select conv_id as session, turn, case when length(text) + [16, 26, 8, 0, 12, 0][1 + turn % 6] > 4096 then 'none' when regexp_matches(text, '(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\b(?:api[_ -]?key|access[_ -]?token|auth(?:orization)?[_ -]?token|password|passwd|secret)\b\s*[:=]\s*\S+|\bBearer\s+[A-Za-z0-9._~+/=-]{12,}|\b(?:sk|pk)-(?:live|test|prod)-[A-Za-z0-9_-]{8,}\b|\bsk-[A-Za-z0-9_-]{12,}\b') then 'none' when turn % 6 = 0 then 'retrieve' when turn % 6 = 1 then 'cue' when turn % 6 = 2 then 'retrieve'
  when turn % 6 = 4 then 'retrieve' else 'none' end as mode from conversations""")
def f15(t):
    rows = prompts(t).withColumn("p", vb.recall_input(F.col("prompt")))
    return rows.select("session", "turn", vb.recall_mode(F.col("p")).alias("mode"))


@query("f18_preview", b.cte(b.RECORDS, r"n as (select *, trim(regexp_replace(statement, '\s+', ' ', 'g')) as flat from records)") + """
select id, md5(case when id % 9 = 0 then '[forget] (content withdrawn)' when length(flat) <= 320 then flat else left(flat, 319) || '…' end) as preview_key, id % 9 = 0 as forgotten from n""")
def f18(t):
    gone = F.col("id") % 9 == 0
    return b.records(t).select("id", F.md5(projection.preview(F.col("statement"), gone)).alias("preview_key"), gone.alias("forgotten"))


@query("f19_evidence_line", b.cte(b.RECORDS, r"""
p as (select *, 'page' || id // 10 as page, case when (id // 10) % 2 = 0 then '{"lang":"x"}' else '{"lang":"' || lang || '"}' end as scope, id % 7 = 0 as external, id % 9 = 0 as forgotten,
  case when id % 6 = 0 then 'inferred' else 'asserted' end as truth, case when id % 8 = 0 then 'open' end as resolution,
  case when id % 3 = 0 then statement else 'source of ' || statement end as source from records),
u as (select *, case when count(*) over w >= 2 and min(scope) over w = max(scope) over w then scope end as page_scope, trim(regexp_replace(source, '\s+', ' ', 'g')) as flat from p window w as (partition by page)),
f as (select *, concat_ws(' ', case when external then '[external, ' || truth || ']' end, case when resolution = 'open' then '[open]' end) as flags,
  concat_ws('; ', 'memory=' || id, 'node=' || node, case when memory_type not in ('fact', 'conversation_evidence') then 'type=' || memory_type end,
   case when not external and truth <> 'asserted' then 'truth=' || truth end, case when page_scope is null then 'scope=' || scope end) as details from u)""") + r"""
select id, md5('- ' || case when flags <> '' then flags || ' ' else '' end || case when forgotten then '[forget] (content withdrawn)' else statement end || chr(10) || '  ' || details ||
  case when forgotten or trim(source) = trim(statement) then '' else chr(10) || '  SOURCE=' || case when length(flat) <= 240 then flat else left(flat, 239) || '…' end end) as line_key, page_scope from f""")
def f19(t):
    k = F.col("id")
    page = F.floor(k / 10)
    rows = b.records(t).select(
        "*", F.concat(F.lit("page"), page).alias("page"),
        F.when(page % 2 == 0, '{"lang":"x"}').otherwise(F.concat(F.lit('{"lang":"'), "lang", F.lit('"}'))).alias("scope"),
        (k % 7 == 0).alias("external"), (k % 9 == 0).alias("forgotten"), F.when(k % 6 == 0, "inferred").otherwise("asserted").alias("truth_status"),
        F.when(k % 8 == 0, "open").alias("resolution"),
        F.when(k % 3 == 0, F.col("statement")).otherwise(F.concat(F.lit("source of "), "statement")).alias("source"),
    )
    return projection.evidence_line(rows, "page").select("id", F.md5("line").alias("line_key"), "page_scope")


@query("f20_retention", b.cte(b.MEMORIES) + f"""
select id, case when id % 8 = 0 or importance > 0.25 or access_count > 1 or status <> 'active' then null
  when storage_state is null and date_diff('day', created_at::date, date '2000-01-01') >= 365 then 'dormant'
  when storage_state = 'dormant' and date_diff('day', created_at::date, date '2000-01-01') >= 365 then 'quarantine' end as recommended_state from memories""")
def f20(t):
    m = b.memories(t).select(
        "*", F.lit(None).cast("timestamp").alias("last_accessed_at"), F.when(F.col("id") % 8 == 0, "open").alias("resolution"),
        F.col("created_at").alias("retention_changed_at"),
    )
    return m.select("id", fl.retention_state(F.to_date(F.lit("2000-01-01"))).alias("recommended_state"))


@query("f21_derivation", b.cte(b.MEMORIES) + """
select id, case when id % 3 = 1 then 'stg' when id % 3 = 2 and source_actor = 'assistant' then 'stg' else 'ltg' end as residence,
  case when id % 7 = 0 then 1.0 when id % 7 = 1 then 0.0 else importance end::double as importance, case when id % 8 = 0 then created_at end as opened_at,
  case when id % 4 = 0 then 0 else 1 end::bigint as tier from memories""")
def f21(t):
    k = F.col("id")
    m = b.memories(t).withColumn("truth", F.when(k % 3 == 1, "inferred").when(k % 3 == 2, "asserted").otherwise("verified"))
    raw = F.when(k % 7 == 0, 1.7).when(k % 7 == 1, -0.5).otherwise(F.col("importance").cast("double"))
    return m.select(
        "id", fl.default_residence(F.col("truth"), F.col("source_actor"), F.lit(None).cast("string")).alias("residence"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.5)))).alias("importance"),
        F.when(k % 8 == 0, F.col("created_at")).alias("opened_at"), F.when(k % 4 == 0, 0).otherwise(1).cast("bigint").alias("tier"),
    )


@query("f22_claims", """
select doc_id as id, case when quality = 1 then 2 else 1 end::bigint as claims, case when quality = 1 and toxic = 1 then 'negative' when quality = 1 then 'affirmative' else 'neutral' end as polarity,
  case when quality = 1 then 'topic' end as predicate_key, case when quality = 1 then 1.0 else 0.25 end::double as confidence from labels""")
def f22(t):
    claim = lambda text, pol, key, conf: F.struct(
        text.alias("text"), pol.alias("polarity"), key.alias("predicateKey"), conf.cast("double").alias("confidence"), F.lit("rule").alias("extractMethod")
    )
    good = F.col("quality") == 1
    raw = F.array(
        claim(F.lit(" background "), F.lit("neutral"), F.lit("x"), F.lit(0.25)),
        claim(F.when(good, " main ").otherwise("  "), F.when(F.col("toxic") == 1, "negative").otherwise("affirmative"), F.lit(" Topic "), F.lit(1.5)),
    )
    c = t.labels.select(F.col("doc_id").alias("id"), fl.normalize_claims(raw).alias("claims")).withColumn("r", fl.representative_claim(F.col("claims")))
    return c.select("id", F.size("claims").cast("bigint").alias("claims"), "r.polarity", F.col("r.predicateKey").alias("predicate_key"), "r.confidence")


@query("f23_markers", b.cte(b.MEMORIES) + """
select m.id, (case when forgotten then 2 else 1 end)::bigint as markers, o_orderpriority || case when m.id % 2 = 0 then '|Second one' else '' end as triggers
from memories m join orders on o_orderkey = m.id""")
def f23(t):
    blank = F.struct(F.lit("  ").alias("kind"), F.create_map(F.lit("value"), F.lit("no")).alias("attributes"))
    trig = lambda v: F.struct(F.lit("recall_trigger").alias("kind"), F.create_map(F.lit("value"), F.lit(v)).alias("attributes"))
    m = b.memories(t).withColumn("raw", F.concat("markers", F.array(blank), "markers"))
    extra = F.when(F.col("id") % 2 == 0, F.concat("raw", F.array(trig("Second  one"), trig("second ONE")))).otherwise(F.col("raw"))
    return m.select("id", F.size(fl.normalize_markers(F.col("raw"))).cast("bigint").alias("markers"), F.array_join(fl.recall_triggers(extra), "|").alias("triggers"))


@query("f24_consolidation_copy", b.cte(b.MEMORIES) + """
select id, 'ltg' as residence, (case when forgotten then 3 else 2 end)::bigint as markers, id::varchar as source_id from memories where id % 3 = 0 and id % 9 <> 0""")
def f24(t):
    m = b.memories(t).withColumn("residence", F.when(F.col("id") % 3 == 0, "stg").otherwise("ltg"))
    cached = F.struct(F.lit("cached_from_ltg").alias("kind"), F.create_map(F.lit("sourceMemoryId"), F.lit("1")).alias("attributes"))
    m = m.withColumn("markers", F.when(F.col("id") % 9 == 0, F.concat("markers", F.array(cached))).otherwise(F.col("markers")))
    note = F.struct(F.lit("consolidated_from_stg").alias("kind"), F.create_map(F.lit("sourceMemoryId"), F.col("id").cast("string")).alias("attributes"))
    copies = m.where((F.col("residence") == "stg") & ~fl.has_marker("cached_from_ltg")).withColumn("markers", F.concat("markers", F.array(note)))
    return copies.select("id", F.lit("ltg").alias("residence"), F.size("markers").cast("bigint").alias("markers"), F.element_at("markers", -1)["attributes"]["sourceMemoryId"].alias("source_id"))


@query("f25_acknowledgements", r"""
with b as (select doc_id as id, regexp_replace(text, '^[^:]{1,20}:\s*', '') as body from documents),
w as (select *, [x for x in regexp_split_to_array(body, '\s+') if x <> ''] as words from b)
select id, len(words)::bigint as words from w where len(words) between 1 and 5 and not regexp_matches(body, '\d') and len([x for x in words[2:] if regexp_matches(x, '^[A-Z]')]) = 0""")
def f25(t):
    body = F.regexp_replace("text", r"^[^:]{1,20}:\s*", "")
    n = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).cast("bigint")
    return t.documents.where(fl.pure_acknowledgement(F.col("text"))).select(F.col("doc_id").alias("id"), n.alias("words"))


@query("f26_slow_traces", b.cte(b.TRACES) + """
select event_id, session * 100 + k as trace from traces where session * 100 + k in (select session * 100 + k from traces where kind = 'view' and value * 20 > 1000)""")
def f26(t):
    phases = b.traces(t).select(
        "event_id", (F.col("session") * 100 + F.col("k")).alias("trace"), F.when(F.col("kind") == "view", "recall").otherwise("other").alias("phase"),
        (F.col("value") * 20).alias("elapsed_ms"),
    )
    return fl.retain_slow(phases, "trace").select("event_id", "trace")
