"""Text, time, array and hash columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.functions import decompose, text as tx, time as tm, vectors as vx, windows as wx
from keelson.plans import bindings as b
from keelson.registry import query
from keelson.session import spread

BL = r"e' \t\n\r'"
SQL_STATEMENT = rf"trim(regexp_replace(regexp_replace(lower(trim({{0}}, {BL})), '[\p{{{{P}}}}\p{{{{S}}}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_statement(column: str) -> str:
    return SQL_STATEMENT.replace("{{", "{").replace("}}", "}").replace("{0}", column)


@query("x1_match_forms", f"""
select doc_id as id, md5({sql_statement('text')}) as statement_key,
  md5(regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')) as identity_key from documents""")
def x1(t):
    return spread(t.documents).select(
        F.col("doc_id").alias("id"), F.md5(tx.statement_form(F.col("text"))).alias("statement_key"),
        F.md5(tx.identity_form(F.col("text"))).alias("identity_key"),
    )


@query("x2_tokenisers", f"""
select doc_id as id,
  len({b.sql_search_terms('text')})::bigint as search_terms,
  md5(array_to_string(list_sort({b.sql_search_terms('text')}), ' ')) as search_key,
  len({b.sql_index_tokens('text')})::bigint as index_tokens,
  len(list_distinct([w for w in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') if regexp_matches(w, '\\p{{N}}')
    or (length(w) >= 4 and w not in ({', '.join(f"'{w}'" for w in tx.FEEDBACK_STOP_WORDS)}))]))::bigint as content_tokens,
  len(list_distinct([w for w in regexp_split_to_array(lower(trim(text, {BL})), '[^\\p{{L}}\\p{{N}}]+') if length(w) >= 2 and w <> 'time']))::bigint as identity_tokens
from documents""")
def x2(t):
    normal = tx.match_form(F.col("text"))
    terms = tx.search_terms(F.col("normal"))
    return spread(t.documents).withColumn("normal", normal).select(
        F.col("doc_id").alias("id"), F.size(terms).cast("bigint").alias("search_terms"),
        F.md5(F.array_join(F.array_sort(terms), " ")).alias("search_key"),
        F.size(tx.index_terms(F.col("text"))).cast("bigint").alias("index_tokens"),
        F.size(tx.content_tokens(F.col("text"))).cast("bigint").alias("content_tokens"),
        F.size(tx.identity_tokens(F.col("normal"))).cast("bigint").alias("identity_tokens"),
    )


X3_PAIRS = f"""pairs as (
  select q.query_id, r.id, lower(trim(q.query, {BL})) as nq, lower(trim(r.statement, {BL})) as nt,
    {b.sql_search_terms('q.query')} as terms
  from queries q join records r on r.node = 'src' || (q.query_id % 20))"""


@query("x3_lexical_text_score", b.cte(b.RECORDS, b.QUERIES, X3_PAIRS) + """
select query_id, id, case when contains(nt, nq) then 10 + length(nq)
    else coalesce(list_sum([length(w) for w in terms if contains(nt, w)]), 0) end::bigint as score,
  len([w for w in terms if contains(nt, w)])::bigint as hit_terms from pairs""")
def x3(t):
    q = b.queries(t).select(
        "query_id", tx.match_form(F.col("query")).alias("nq"), F.concat(F.lit("src"), F.col("query_id") % 20).alias("node")
    ).withColumn("terms", tx.search_terms(F.col("nq")))
    r = b.records(t).select("id", "node", tx.match_form(F.col("statement")).alias("nt"))
    pairs = r.join(q, "node").withColumn("hits", F.filter("terms", lambda w: F.col("nt").contains(w)))  # looked for once
    return pairs.select(
        "query_id", "id", tx.lexical_score(F.col("nq"), F.col("nt"), F.col("terms"), F.col("hits")).cast("bigint").alias("score"), F.size("hits").cast("bigint").alias("hit_terms"),
    )


def _gram_overlap(n: int):
    """Multiset overlap features of the word-internal n-grams of two texts (arrays ``lw``/``rw``)."""

    def grams(words):
        return F.flatten(F.transform(words, lambda w: tx.char_ngrams(w, n)))

    return grams(F.col("lw")), grams(F.col("rw"))


@query("x4_pair_features", f"""
with p as (select a.conv_id, a.turn, {b.sql_words('a.text')} as l, {b.sql_words('c.text')} as r
  from conversations a join conversations c on c.conv_id = a.conv_id and c.turn = a.turn + 1),
w as (select *, list_distinct(string_split(l, ' ')) as lw, list_distinct(string_split(r, ' ')) as rw from p),
g as (select *, flatten([[substr(x, i::int, 3) for i in range(1, length(x) - 1)] for x in string_split(l, ' ')]) as lg,
   flatten([[substr(x, i::int, 3) for i in range(1, length(x) - 1)] for x in string_split(r, ' ')]) as rg from w),
lc as (select conv_id, turn, u.x as gram, count(*) as n from g, unnest(lg) as u(x) group by all),
rc as (select conv_id, turn, u.x as gram, count(*) as n from g, unnest(rg) as u(x) group by all),
j as (select coalesce(lc.conv_id, rc.conv_id) as conv_id, coalesce(lc.turn, rc.turn) as turn,
   coalesce(lc.n, 0) as a, coalesce(rc.n, 0) as b from lc full join rc using (conv_id, turn, gram)),
s as (select conv_id, turn, sum(least(a, b)) as i, sum(greatest(a, b)) as u, sum(a * b) as dot, sum(a * a) as na, sum(b * b) as nb, sum(a) as ca from j group by 1, 2)
select w.conv_id, w.turn, (l = r) as equal,
  round(least(length(replace(l, ' ', '')), length(replace(r, ' ', ''))) / greatest(1, length(replace(l, ' ', '')), length(replace(r, ' ', '')))::double, 6) as length_ratio,
  round(len(list_intersect(lw, rw)) / len(list_distinct(list_concat(lw, rw)))::double, 6) as word_jaccard,
  round(len(list_intersect(lw, rw)) / len(lw)::double, 6) as word_coverage,
  round(coalesce(i / nullif(u, 0)::double, 0), 6) as trigram_jaccard,
  round(coalesce(i / nullif(ca, 0)::double, 0), 6) as trigram_coverage,
  round(coalesce(dot / nullif(sqrt(na * nb), 0), 0), 6) as trigram_cosine
from w left join s using (conv_id, turn)""")
def x4(t):
    from keelson.operators import similarity

    c = t.conversations
    left = c.select("conv_id", "turn", tx.words_only(F.col("text")).alias("l"))
    right = c.select("conv_id", (F.col("turn") - 1).alias("turn"), tx.words_only(F.col("text")).alias("r"))
    f = similarity.pair_features(left.join(right, ["conv_id", "turn"]), "l", "r", sizes=(3,))
    return f.select(
        "conv_id", "turn", "equal", *[F.round(x, 6).alias(x) for x in ("length_ratio", "word_jaccard", "word_coverage")],
        F.round("gram3_jaccard", 6).alias("trigram_jaccard"), F.round("gram3_coverage", 6).alias("trigram_coverage"),
        F.round("gram3_cosine", 6).alias("trigram_cosine"),
    )


@query("x5_event_time_phrases", """
with p as (select o_orderkey, o_orderkey % 9 as c, o_orderdate::date as d from orders)
select o_orderkey as id,
  case c when 0 then d when 1 then d when 2 then d when 3 then d when 4 then d - 1 when 5 then d - 3
    when 6 then (date_trunc('month', d) - interval 2 month)::date when 7 then (date_trunc('year', d) - interval 1 year)::date end::timestamp as start,
  case c when 6 then 'month' when 7 then 'year' when 8 then null else 'day' end as grain,
  case c when 6 then last_day((date_trunc('month', d) - interval 2 month)::date) when 7 then make_date(year(d) - 1, 12, 31) when 8 then null
    when 4 then d - 1 when 5 then d - 3 else d end::date as end_day
from p""")
def x5(t):
    d = F.to_date("o_orderdate")
    fmt = lambda f: F.date_format("o_orderdate", f)
    case = F.col("o_orderkey") % 9
    phrase = (
        F.when(case == 0, fmt("yyyy-MM-dd")).when(case == 1, fmt("yyyy/M/d")).when(case == 2, fmt("yyyy年M月d日"))
        .when(case == 3, fmt("MMM d, yyyy")).when(case == 4, "yesterday").when(case == 5, "3 days ago")
        .when(case == 6, "两个月前").when(case == 7, "去年").otherwise("some day soon")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), phrase.alias("phrase"), F.col("o_orderdate").alias("reference"))
    parsed = rows.withColumn("p", tm.parse_phrases(F.array("phrase"), F.col("reference"))[0])
    return parsed.select("id", F.col("p.start").alias("start"), F.when(F.col("p.start").isNotNull(), F.col("p.grain")).alias("grain"), F.to_date("p.end").alias("end_day"))


@query("x6_query_windows", """
with p as (select o_orderkey, o_orderkey % 5 as c, o_orderdate::date as d from orders)
select o_orderkey as id,
  case c when 0 then null when 1 then d when 2 then d when 3 then d end::timestamp as window_from,
  case c when 0 then d when 1 then d when 2 then null when 3 then d + 40 end::date as to_day from p""")
def x6(t):
    case = F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "yyyy-MM-dd")
    text = (
        F.when(case == 0, F.concat(F.lit("status as of "), day)).when(case == 1, F.concat(F.lit("what happened on "), iso))
        .when(case == 2, F.concat(F.lit("anything since "), day))
        .when(case == 3, F.concat(F.lit("orders from "), iso, F.lit(" to "), later)).otherwise("no date here")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("q"), F.col("o_orderdate").alias("reference"))
    out = tm.with_event_window(rows, "q", "reference")
    return out.select("id", "window_from", F.to_date("window_to").alias("to_day"))


@query("x7_embedding_text", """
with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prev from conversations),
n as (select *, trim(regexp_replace(coalesce(prev, ''), '\\s+', ' ', 'g')) as pv from p)
select conv_id, turn, md5('2024-01-' || lpad((1 + conv_id % 28)::varchar, 2, '0') || ' ' || text ||
  case when pv = '' then '' else chr(10) || 'previous: ' || case when length(pv) > 240 then left(pv, 240) || '…' else pv end end) as digest
from n""")
def x7(t):
    from keelson.operators import expansion

    turns = expansion.previous_turn(b.turns(t))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("session") % 28 + 1).cast("string"), 2, "0"))
    return turns.select(
        F.col("session").alias("conv_id"), F.col("ordinal").alias("turn"),
        F.md5(expansion.embedding_text(F.col("content"), day, F.col("previous"))).alias("digest"),
    )


@query("x8_stable_ids", """
select doc_id as id, sha256('["memory","' || source || '","' || doc_id || '"]') as memory_id from documents""")
def x8(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), tx.stable_id(F.lit("memory"), F.col("source"), F.col("doc_id")).alias("memory_id")
    )


SQL_PREVIEW = (
    "(case when length({0}) <= 320 then {0} else left({0}, 319) || '…' end)"
)


@query("x9_disclosure_hash", b.cte(b.RECORDS, r"""
n as (select *, trim(regexp_replace(statement, '\s+', ' ', 'g')) as flat from records)""") + f"""
select id, sha256(node || chr(31) || memory_type || chr(31) || {SQL_PREVIEW.format('flat')}) as header_hash,
  sha256(statement) as exact_hash from n""")
def x9(t):
    from keelson.operators import projection

    r = b.records(t)
    preview = projection.preview(F.col("statement"), F.lit(False))
    return r.select(
        "id", F.sha2(F.concat_ws("\u001f", "node", "memory_type", preview), 256).alias("header_hash"),
        F.sha2("statement", 256).alias("exact_hash"),
    )


@query("x10_vector_hygiene", """
select vec_id as id, len(embedding)::bigint as dimensions, round(sqrt(list_sum([x * x for x in embedding::double[]])), 6) as norm,
  true as finite, round(list_sum([x / sqrt(list_sum([y * y for y in embedding::double[]])) for x in embedding::double[]]), 6) as unit_sum
from embeddings""")
def x10(t):
    e = t.embeddings.withColumn("v", vx.as_double(F.col("embedding")))
    unit = vx.unit(F.col("v"))
    return e.select(
        F.col("vec_id").alias("id"), F.size("v").cast("bigint").alias("dimensions"), F.round(vx.norm(F.col("v")), 6).alias("norm"),
        vx.all_finite(F.col("v")).alias("finite"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"),
    )


@query("x11_hashed_embedding", r"""
with tok as (select conv_id * 1000 + turn as id, u.w from conversations, unnest(regexp_extract_all(lower(trim(text, e' \t\n\r')), '[\p{L}\p{N}_+.#-]+')) as u(w)),
feat as (select id, w as f from tok union all select id, substr(w, i::int, 3) from tok, unnest(range(1, length(w) - 1)) as r(i)),
uniq as (select distinct f from feat),
hashed as (select f, list_reduce(list_concat([2166136261::ubigint], [ord(c)::ubigint for c in regexp_extract_all(f, '.')]), lambda h, c: (xor(h, c) * 16777619::ubigint) & 4294967295::ubigint) as h from uniq),
dims as (select id, (h % 256)::bigint as bucket, sum(case when h % 2 = 0 then 1 else -1 end) as v from feat join hashed using (f) group by 1, 2)
select id, count(*) as used, round(sum(bucket * v) / sqrt(sum(v * v)), 6) as signature from dims where v <> 0 group by 1""")
def x11(t):
    from keelson.operators import dense

    texts = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    dims = dense.hashed_dimensions(texts, "id", "text", 256)
    return dims.groupBy("id").agg(
        F.count("*").alias("used"), F.round(F.sum(F.col("bucket") * F.col("v")) / F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("signature")
    )


@query("x12_query_windows", r"""
with d as (select doc_id, text, length(text) as size from documents),
c as (select *, least(ceil(size / 2000.0), 10)::bigint as n from d),
cuts as (select doc_id, i, case when i = 0 then 0 when i = n then size else (
   with x as (select floor(i * size / n::double + 0.5)::bigint as ideal),
   y as (select ideal, least(size - 1, ideal + 400) as ceiling from x),
   z as (select ideal, ceiling, substr(text, ideal + 1, ceiling - ideal + 2) as s from y),
   m as (select ideal, ceiling, case when regexp_matches(s, '\n|[.?!] |[。；，]') then length(regexp_extract(s, '(?s)^(.*?)(?:\n|[.?!] |[。；，])', 1)) + 1 else 0 end as hit from z)
   select case when hit > 0 and ideal + hit - 1 <= ceiling then ideal + hit else least(ideal, ceiling) end from m) end as cut
  from c, unnest(range(0, n + 1)) as r(i) where size > 2000 and size <= n * 2000),
covered as (select doc_id, i - 1 as pos, lag(cut) over (partition by doc_id order by i) as a, cut as b from cuts),
sampled as (select doc_id, i as pos, case when i = 0 then 0 when i = n - 1 then size - 2000
    else floor(i * ((size - n * 2000) / (n - 1)::double + 2000) + 0.5)::bigint end as a from c, unnest(range(0, n)) as r(i) where size > n * 2000)
select doc_id as id, 0::bigint as pos, md5(text) as digest from c where size <= 2000
union all select doc_id, pos, md5(substr(text, a + 1, b - a)) from covered join d using (doc_id) where pos >= 0 and b > a
union all select doc_id, pos, md5(substr(text, a + 1, 2000)) from sampled join d using (doc_id)""")
def x12(t):
    windows = spread(t.documents).select(F.col("doc_id").alias("id"), wx.query_windows(F.col("text")).alias("ws"))
    cut = windows.select("id", F.posexplode_outer("ws").alias("pos", "w"))
    return cut.select("id", F.col("pos").cast("bigint").alias("pos"), F.md5("w").alias("digest"))


QSTOP = ", ".join(f"'{w}'" for w in decompose.QUESTION_STOP_WORDS)


@query("x13_static_decomposition", rf"""
with s as (select item_id, ['where ', 'when ', 'who ', ''][1 + item_id % 4] || text as q from benchmark),
w as (select item_id, q, [x for x in [regexp_replace(y, '[^\p{{L}}\p{{N}}''-]', '', 'g') for y in regexp_split_to_array(q, '\s+')] if x <> '' and lower(x) not in ({QSTOP})] as words from s)
select item_id as id, array_to_string(words[1:10], ' ') as content_clause,
  case item_id % 4 when 3 then null else len([x for x, i in words if i > 1 and regexp_matches(x, '^[A-Z]')])::bigint end as entities,
  case item_id % 4 when 0 then 'location' when 1 then 'date' when 2 then 'person' end as aspect from w""")
def x13(t):
    lead = F.element_at(F.array(F.lit("where "), F.lit("when "), F.lit("who "), F.lit("")), (F.col("item_id") % 4 + 1).cast("int"))
    q = t.benchmark.select(F.col("item_id").alias("id"), F.concat(lead, "text").alias("q"))
    words = decompose.content_words(F.col("q"))
    aspect = decompose.aspect_clause(F.col("q"))
    entities = F.size(F.filter(words, lambda x, i: (i > 0) & x.rlike("^[A-Z]"))).cast("bigint")
    return q.select(
        "id", decompose.content_clause(F.col("q")).alias("content_clause"), F.when(aspect.isNotNull(), entities).alias("entities"),
        F.regexp_extract(aspect, r"\b(location|date|person)\b", 1).alias("aspect"),
    ).withColumn("aspect", F.when(F.col("aspect") != "", F.col("aspect")))


def option_letters(value):
    low = F.lower(value)
    bracketed = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\(([a-d])\)"), F.lit(1)))
    bare = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b([a-d])\b"), F.lit(1)))
    return F.when(F.size(bracketed) > 0, bracketed).otherwise(bare)


def choice_correct(hypothesis, reference):
    """Multi-choice grading: exactly one option letter, in the final answer or the whole text."""
    expected = F.regexp_replace(F.lower(reference), r"[()\s]", "")
    tail = F.trim(F.regexp_replace(F.substring_index(hypothesis, "<final_answer>", -1), r"</final_answer>\s*$", ""))
    final = F.when(hypothesis.contains("<final_answer>"), tail).otherwise(F.trim(hypothesis))

    def single(value):
        letters = option_letters(value)
        return (F.size(letters) == 1) & F.array_contains(letters, expected)

    return single(final) | single(hypothesis)


SQL_LETTERS = (
    r"(case when regexp_matches(lower({0}), '\([a-d]\)') then list_distinct(regexp_extract_all(lower({0}), '\(([a-d])\)', 1)) "
    r"else list_distinct(regexp_extract_all(lower({0}), '\b([a-d])\b', 1)) end)"
)


@query("x14_choice_grading", rf"""
with h as (select event_id, chr((97 + user_id % 4)::int) as letter, case event_id % 4
  when 0 then 'I think <final_answer>(' || chr((97 + user_id % 4)::int) || ')</final_answer>'
  when 1 then 'both (' || chr((97 + user_id % 4)::int) || ') or (b)' when 2 then 'answer ' || chr((97 + user_id % 3)::int)
  else '<final_answer>' || event_type || '</final_answer>' end as hyp from events),
f as (select *, case when contains(hyp, '<final_answer>') then trim(regexp_replace(regexp_replace(hyp, '^.*<final_answer>', ''), '</final_answer>\s*$', '')) else trim(hyp) end as fin from h)
select event_id as id, ((len({SQL_LETTERS.format('fin')}) = 1 and list_contains({SQL_LETTERS.format('fin')}, letter))
  or (len({SQL_LETTERS.format('hyp')}) = 1 and list_contains({SQL_LETTERS.format('hyp')}, letter))) as correct from f""")
def x14(t):
    letter = F.char((F.col("user_id") % 4 + 97).cast("bigint"))
    third = F.char((F.col("user_id") % 3 + 97).cast("bigint"))
    case = F.col("event_id") % 4
    hyp = (
        F.when(case == 0, F.concat(F.lit("I think <final_answer>("), letter, F.lit(")</final_answer>")))
        .when(case == 1, F.concat(F.lit("both ("), letter, F.lit(") or (b)")))
        .when(case == 2, F.concat(F.lit("answer "), third))
        .otherwise(F.concat(F.lit("<final_answer>"), "event_type", F.lit("</final_answer>")))
    )
    rows = t.events.select(F.col("event_id").alias("id"), hyp.alias("h"), F.concat(F.lit("("), letter, F.lit(")")).alias("r"))
    return rows.select("id", choice_correct(F.col("h"), F.col("r")).alias("correct"))


@query("x15_part_flattening", r"""
with p as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, url, html from pages)
select page_id as id, md5(title || chr(10) || html) as text_key, 1::bigint as images, sha256(url) as image_hash from p""")
def x15(t):
    from keelson.operators import projection

    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))
    none = F.lit(None).cast("string")
    parts = F.to_json(F.array(part("text", title, none), part("image_url", none, F.col("url")), part("text", F.col("html"), none)))
    flat = projection.flatten_parts(t.pages.select(F.col("page_id").alias("id"), parts.alias("content")), "content")
    return flat.select(
        "id", F.md5("text_view").alias("text_key"), F.size("image_hashes").cast("bigint").alias("images"), F.col("image_hashes")[0].alias("image_hash")
    )
