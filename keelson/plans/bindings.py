"""Views every registered query starts from, as DataFrames and as SQL.

records  = documents     queries = benchmark        turns  = conversations
vectors  = embeddings    votes   = labels+documents traces = events
states   = orders        baskets = lineitem         edges  = nation/customer/supplier keys
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keelson.functions import text as tx
from keelson.registry import Tables
from keelson.session import spread

NOW = "2024-02-01 00:00:00"


def records(t: Tables) -> DataFrame:
    d = spread(t.documents)
    chars = F.col("n_chars")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("node"),
        "lang",
        F.col("text").alias("statement"),
        "n_chars",
        F.when(chars < 500, 0).when(chars < 1500, 1).when(chars < 4000, 2).otherwise(3).alias("tier"),
        ((F.col("doc_id") * 37 % 101) / 100.0).alias("importance"),
        F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "de", "event")
        .when(F.col("lang") == "fr", "preference").otherwise("conversation_evidence").alias("memory_type"),
    )


RECORDS = """records as (
  select doc_id as id, source as node, lang, text as statement, n_chars,
    case when n_chars < 500 then 0 when n_chars < 1500 then 1 when n_chars < 4000 then 2 else 3 end as tier,
    (doc_id * 37 % 101) / 100.0 as importance,
    case lang when 'en' then 'fact' when 'de' then 'event' when 'fr' then 'preference'
      else 'conversation_evidence' end as memory_type
  from documents)"""


def queries(t: Tables) -> DataFrame:
    """Query set; the text is the first half of the passage so retrieval is not trivial."""
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    return t.benchmark.select(F.col("item_id").alias("query_id"), half.alias("query"), "text")


QUERIES = """queries as (
  select item_id as query_id, substring(text, 1, length(text) // 2) as query, text from benchmark)"""

STOP_LIST = ", ".join(f"'{w}'" for w in tx.SEARCH_STOP_WORDS)

# Spark: tx.index_terms / tx.query_index_terms (no Han script in the test tables).
SQL_INDEX_TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
SQL_SEARCH_TERMS = (
    "list_distinct([w for w in regexp_extract_all(lower(trim({0}, e' \\t\\n\\r')), '[\\p{{L}}\\p{{N}}_+.#-]+') "
    "if length(w) >= 2 and w not in (" + STOP_LIST + ")])"
)


def sql_index_tokens(column: str) -> str:
    return SQL_INDEX_TOKENS.format(column)


def sql_search_terms(column: str) -> str:
    return SQL_SEARCH_TERMS.format(column)


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content")
    )


TURNS = """turns as (
  select conv_id as session, turn as ordinal, role, text as content from conversations)"""


def gold(t: Tables) -> DataFrame:
    """Query/record pairs where the record contains the whole passage (compared as words).

    Candidates come from an equi-join on the rarest-friendly anchor: the passage's first eight
    words, found in a record by hashing its own eight-word windows; `contains` then verifies.
    """
    from keelson.operators.evaluation import containment_pairs

    r = records(t).select("id", F.col("statement").alias("haystack"))
    q = queries(t).select("query_id", F.col("text").alias("needle"))
    return containment_pairs(q, r)


SQL_WORDS = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql_words(column: str) -> str:
    return SQL_WORDS.format(column)


GOLD = f"""gold as (
  select q.query_id, d.id from (select query_id, {sql_words('text')} w from queries) q
  join (select id, {sql_words('statement')} w from records) d on contains(d.w, q.w))"""


def traces(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("session"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


TRACES = """traces as (
  select event_id, ts, user_id as session, event_type as kind, value,
    cast(json_extract_string(props, '$.k') as int) as k from events)"""


def votes(t: Tables) -> DataFrame:
    """One vote per (record, claim): quality on claim 0, toxicity on claim 1."""
    base = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    outcome: Column = F.when(
        F.col("claim_index") == 0, F.when(F.col("quality") == 1, "supported").otherwise("contradicted")
    ).otherwise(F.when(F.col("toxic") == 1, "contradicted").otherwise("supported"))
    return (
        base.withColumn("claim_index", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.col("doc_id").alias("id"), "claim_index", F.col("source").alias("task"), "lang",
            outcome.alias("outcome"), (F.lit(1.0) / (1 + F.col("claim_index"))).alias("weight"),
        )
    )


VOTES = """votes as (
  select l.doc_id as id, c.claim_index, d.source as task, d.lang,
    case when c.claim_index = 0 then case when quality = 1 then 'supported' else 'contradicted' end
      else case when toxic = 1 then 'contradicted' else 'supported' end end as outcome,
    1.0::double / (1 + c.claim_index) as weight
  from labels l join documents d on d.doc_id = l.doc_id,
    (values (0), (1)) c(claim_index))"""


def states(t: Tables) -> DataFrame:
    """Versioned state rows: one key per customer, one version per order."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("state_key"),
        F.col("o_orderdate").alias("valid_from"), F.col("o_orderstatus").alias("value"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"),
    )


STATES = """states as (
  select o_orderkey as id, o_custkey as state_key, o_orderdate as valid_from, o_orderstatus as value,
    o_orderpriority as priority, o_totalprice as amount from orders)"""


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding", "label"
    )


def vector_corpus(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), "embedding", "label")


VECTORS = """qv as (select vec_id as query_id, embedding::double[] as qe, label as qlabel from embeddings where vec_id % 50 = 0),
 cv as (select vec_id as id, embedding::double[] as ce, label from embeddings where vec_id % 50 <> 0)"""


def edges(t: Tables) -> DataFrame:
    """Typed graph edges between prefixed keys; strength is a stable hash in [0, 1)."""
    nation = t.nation.select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"),
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"), F.lit("part_of").alias("type"),
        (F.col("n_nationkey") * 7919 % 97).alias("h"),
    )
    customer = t.customer.select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("dst"), F.lit("related_to").alias("type"),
        (F.col("c_custkey") * 7919 % 97).alias("h"),
    )
    supplier = t.supplier.select(
        F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"),
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"), F.lit("depends_on").alias("type"),
        (F.col("s_suppkey") * 7919 % 97).alias("h"),
    )
    joined = nation.unionByName(customer).unionByName(supplier)
    return joined.select(
        F.concat_ws(">", "src", "dst").alias("edge_id"), "src", "dst", "type", (F.col("h") / 97.0).alias("strength")
    )


EDGES = """edges as (
  select src || '>' || dst as edge_id, src, dst, type, h / 97.0::double as strength from (
    select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 'part_of' as type, n_nationkey * 7919 % 97 as h from nation
    union all select 'n' || c_nationkey, 'c' || c_custkey, 'related_to', c_custkey * 7919 % 97 from customer
    union all select 'n' || s_nationkey, 's' || s_suppkey, 'depends_on', s_suppkey * 7919 % 97 from supplier))"""


def cte(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def memories(t: Tables) -> DataFrame:
    """Records with lifecycle columns, from orders."""
    k = F.col("o_orderkey")
    marker = F.struct(F.lit("forget").alias("kind"), F.create_map(F.lit("by"), F.lit("user")).alias("attributes"))
    plain = F.struct(F.lit("recall_trigger").alias("kind"), F.create_map(F.lit("value"), F.col("o_orderpriority")).alias("attributes"))
    return t.orders.select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active").alias("status"),
        F.when(k % 4 == 0, F.col("o_custkey") % 10).alias("session"),
        F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("interval 700 days")).alias("expires_at"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(k % 5 == 0, F.col("o_orderdate") + F.expr("interval 1500 days")).alias("valid_until"),
        F.when(k % 11 == 0, F.array(plain, marker)).otherwise(F.array(plain)).alias("markers"),
        F.when(k % 13 == 0, "dormant").alias("storage_state"),
        F.when(k % 2 == 0, "user").otherwise("assistant").alias("source_actor"),
        F.create_map(F.lit("segment"), F.substring("o_orderpriority", 1, 1), F.lit("site"), (F.col("o_custkey") % 3).cast("string")).alias("scope"),
        F.col("o_custkey").alias("node"), F.col("o_totalprice").alias("amount"), (k % 100 / 100.0).alias("importance"),
        (k % 6).alias("access_count"), F.col("o_orderdate").alias("created_at"),
    )


MEMORIES = """memories as (
  select o_orderkey as id, case when o_orderstatus = 'P' then 'superseded' else 'active' end as status,
    case when o_orderkey % 4 = 0 then o_custkey % 10 end as session,
    case when o_orderkey % 3 = 0 then o_orderdate + interval 700 day end as expires_at,
    o_orderdate as valid_from,
    case when o_orderkey % 5 = 0 then o_orderdate + interval 1500 day end as valid_until,
    o_orderkey % 11 = 0 as forgotten,
    case when o_orderkey % 13 = 0 then 'dormant' end as storage_state,
    case when o_orderkey % 2 = 0 then 'user' else 'assistant' end as source_actor,
    substr(o_orderpriority, 1, 1) as segment, (o_custkey % 3)::varchar as site,
    o_custkey as node, o_totalprice as amount, o_orderkey % 100 / 100.0 as importance, o_orderkey % 6 as access_count,
    o_orderdate as created_at
  from orders)"""
