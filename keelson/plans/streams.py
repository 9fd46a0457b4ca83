"""Stream runs over everything available, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from keelson.plans import bindings as b
from keelson.plans.predicates import SQL_POLICY, policy_rows
from keelson.registry import query
from keelson.streaming import ordered, streams as st, views as vw

c = F.col
big = lambda x, name=None: c(x).cast("bigint").alias(name or x)


def live(t, name: str):
    return st.parquet_stream(t.spark, t.sf_dir, name)


def live_events(t):
    e = live(t, "events")
    return e.select(
        "event_id", c("ts").cast("timestamp").alias("time"), c("user_id").alias("session"), c("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


class _Live:
    """The same table names, served as streams, so batch bindings build streaming inputs."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name):
        return live(self._t, name)


@query("t1_policy_stream", b.cte(SQL_POLICY) + """
select case when reason = 'allowed' then 'accepted' else 'rejected' end as decision, reason, count(*) as rows from classified group by 1, 2""")
def t1(t):
    root = st.stream_root(t.spark)
    st.policy_split(policy_rows(_Live(t)), root)
    return t.spark.read.parquet(f"{root}/audit").groupBy("decision", "reason").agg(F.count("*").alias("rows"))


@query("t2_message_dedup", b.cte(b.TRACES) + "select distinct session, k from traces")
def t2(t):
    return st.run_to_table(st.dedup_messages(live_events(t), ["session", "k"], "time", "2 days")).select("session", "k")


VOTE_POST = b.cte(b.TRACES, """p as (select session as id, k % 2 as claim_index, 1 + 2 * 0.5 + sum(case when value > 15 then 1 else 0 end) as alpha, 1 + 2 * 0.5 + sum(case when value > 15 then 0 else 1 end) as beta, count(*) as votes from traces group by 1, 2)""")


@query("t3_running_posteriors", VOTE_POST + "select id, claim_index, votes, round(alpha / (alpha + beta), 6) as mean from p")
def t3(t):
    votes = live_events(t).select(
        c("session").alias("id"), (c("k") % 2).alias("claim_index"), F.when(c("value") > 15, "supported").otherwise("contradicted").alias("outcome"), F.lit(1.0).alias("weight")
    )
    root = st.stream_root(t.spark)
    st.running_posteriors(votes, 0.5, root)
    claims = t.spark.read.parquet(f"{root}/claims")
    latest = claims.groupBy("id", "claim_index").agg(F.max_by(F.struct("votes", "mean"), "batch").alias("s"))
    return latest.select("id", "claim_index", "s.votes", F.round("s.mean", 6).alias("mean"))


@query("t3_claim_transitions", b.cte(b.TRACES, """
v as (select session * 10 + k % 2 as claim, event_id, ts, value > 8 as good from traces),
r as (select *, sum(good::int) over w as g, count(*) over w as n from v window w as (partition by claim order by ts, event_id rows unbounded preceding)),
p as (select *, (2 + g) / (4.0 + n) as mean from r), l as (select *, greatest(0, mean - 1.96 * sqrt(mean * (1 - mean) / (5 + n))) as lower from p),
a as (select *, last_value(case when n >= 3 and mean >= 0.75 and lower >= 0.5 then 1 when mean < 0.65 or lower < 0.35 then 0 end ignore nulls) over (partition by claim order by ts, event_id rows unbounded preceding) as active from l),
t as (select *, coalesce(lag(active) over (partition by claim order by ts, event_id), 0) as before from a)""") + """
select claim, event_id, case when active = 1 then 'promoted' else 'retracted' end as transition from t where coalesce(active, 0) <> before""")
def t3_transitions(t):
    votes = live_events(t).select((c("session") * 10 + c("k") % 2).alias("claim"), "event_id", "time", (c("value") > 8).alias("supported"))
    return st.run_to_table(st.claim_transitions(votes, 0.5))


@query("t4_session_working_set")
def t4(t):
    e = live_events(t).select("session", "event_id", "time", (c("k") % 40).alias("item"), F.least(c("value") / 100, F.lit(1.0)).alias("activation"))
    return st.run_to_table(st.working_set(e, most_items=8))


@query("t4_working_set_budget")
def t4_budget(t):
    """Frames, character budget, pins and times to live; brute force in the tests."""
    action = F.when(c("kind") == "purchase", "maintain").when(c("kind") == "error", F.when(c("k") % 2 == 0, "clear").otherwise("observe")).otherwise("observe")
    e = live_events(t).select(
        "session", "time", "event_id", action.alias("action"), (c("k") % 7).cast("bigint").alias("frame"), F.concat(F.lit("i"), (c("k") % 23).cast("string")).alias("item"),
        (10 + c("k") % 50).cast("bigint").alias("size"), F.least(c("value") / 100, F.lit(1.0)).alias("activation"), F.when(c("k") % 3 == 0, F.lit(6 * 3_600_000_000)).alias("ttl"),
    )
    return st.run_to_table(ordered.working_set_stream(e, "1 hour", items=12, characters=400, frames=4))


@query("t5_disclosure_fold")
def t5(t):
    e = live_events(t).select("session", "event_id", "time", (c("k") % 12).alias("memory"), c("kind").alias("content"), (c("k") % 3).alias("depth"))
    return st.run_to_table(st.disclosure_fold(e))


@query("t6_phrase_pool")
def t6(t):
    e = live_events(t).select("session", "event_id", "time", F.concat_ws(":", "kind", (c("k") % 5).cast("string")).alias("phrase"))
    return st.run_to_table(st.phrase_pool(e, capacity=12, protected=4))


@query("t7_task_window", r"""
with f as (select conv_id as session, turn as ordinal, trim(regexp_replace(case when turn % 3 = 2 then 'please continue' else text end, '\s+', ' ', 'g')) as flat from conversations),
a as (select *, case when length(flat) >= 40 or regexp_matches(flat, '(?i)(?:[A-Za-z][\w.-]{2,}[-_/][\w./-]+|\b(?:fix|implement|debug|test|build|refactor|install|configure)\b)') then left(flat, 480) end as anchor from f),
n as (select *, last_value(anchor ignore nulls) over (partition by session order by ordinal rows between unbounded preceding and 1 preceding) as latest from a),
p as (select *, last_value(case when anchor is distinct from latest and anchor is not null then concat_ws(chr(10), latest, anchor) end ignore nulls) over (partition by session order by ordinal rows between unbounded preceding and 1 preceding) as prior from n)
select session, ordinal, length(flat) <= 100 and prior is not null and regexp_matches(flat, '(?i)\b(?:continue|again|retry|reload|try|proceed|go on|fix it|test it)\b') as continued,
  md5(case when length(flat) <= 100 and prior is not null and regexp_matches(flat, '(?i)\b(?:continue|again|retry|reload|try|proceed|go on|fix it|test it)\b') then prior end) as context, anchor is not null as substantive from p""")
def t7(t):
    prompt = F.when(c("turn") % 3 == 2, "please continue").otherwise(c("text"))
    turns = t.conversations.select(c("conv_id").alias("session"), c("turn").alias("ordinal"), prompt.alias("prompt"))
    return vw.task_window(turns).select("session", "ordinal", "continued", F.md5("context").alias("context"), "substantive")


@query("t7_window_stream", r"""
with f as (select conv_id as session, turn as ordinal, conv_id * 60 + turn as minute, trim(regexp_replace(case when turn % 3 = 2 then 'please continue' else text end, '\s+', ' ', 'g')) as flat from conversations),
a as (select *, case when length(flat) >= 40 or regexp_matches(flat, '(?i)(?:[A-Za-z][\w.-]{2,}[-_/][\w./-]+|\b(?:fix|implement|debug|test|build|refactor|install|configure)\b)') then left(flat, 480) end as anchor,
  length(flat) <= 100 and regexp_matches(flat, '(?i)\b(?:continue|again|retry|reload|try|proceed|go on|fix it|test it)\b') as again from f),
n as (select *, last_value(anchor ignore nulls) over (partition by session order by ordinal rows between unbounded preceding and 1 preceding) as latest from a),
p as (select *, last_value(case when anchor is distinct from latest and anchor is not null then concat_ws(chr(10), latest, anchor) end ignore nulls) over (partition by session order by ordinal rows between unbounded preceding and 1 preceding) as prior from n)
select session, ordinal, again and prior is not null as continued, md5(case when again then prior end) as context, anchor is not null as substantive
from p where minute <= (select max(minute) - 120 from f)""")
def t7_stream(t):
    prompt = F.when(c("turn") % 3 == 2, "please continue").otherwise(c("text"))
    minute = ((c("conv_id") + 1) * 60 + c("turn")) * 60  # conversations follow one another by the hour
    turns = live(t, "conversations").select(c("conv_id").alias("session"), F.timestamp_seconds(minute).alias("time"), c("turn").cast("bigint").alias("ordinal"), prompt.alias("prompt"))
    out = st.run_to_table(ordered.task_window_stream(turns, "2 hours"))
    return out.select("session", c("ordinal").cast("int").alias("ordinal"), "continued", F.md5("context").alias("context"), "substantive")


@query("t8_rolling_histograms", """
with w as (select event_type as section, value, to_timestamp(u.s * 43200)::timestamp as start from (select *, floor(epoch(ts) / 43200)::bigint as h from events) e, lateral (values (h), (h - 1)) u(s)),
m as (select max(ts) - interval 1 hour as mark from events)
select start, section, count(*) as count, round(sum(value), 4) as sum from w, m where start + interval 1 day <= mark group by 1, 2""")
def t8(t):
    e = live_events(t).select("time", c("kind").alias("section"), c("value").alias("ms"))
    out = st.run_to_table(st.rolling_histograms(e, "section", "ms", "time", "1 day", "12 hours", "1 hour"))
    merged = out.groupBy("start", "section").agg(F.sum("count").alias("count"), F.round(F.sum("sum"), 4).alias("sum"))
    return merged.withColumn("start", c("start").cast("timestamp_ntz"))


@query("t9_sessionisation", """
with g as (select user_id as session, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as n from events),
s as (select session, ts, sum(n) over (partition by session order by ts rows unbounded preceding) as sid from g), a as (select session, min(ts) as start, max(ts) + interval 6 hour as e, count(*) as events from s group by session, sid)
select session, start, events from a, (select max(ts) - interval 1 hour as mark from events) where e <= mark""")
def t9(t):
    out = st.run_to_table(st.sessions(live_events(t), "session", "time", "6 hours", "1 hour"))
    return out.select("session", c("start").cast("timestamp_ntz").alias("start"), "events")


@query("t10_index_backfill", "select doc_id as id from documents where doc_id not in (select vec_id from embeddings)")
def t10(t):
    root = st.stream_root(t.spark)
    docs = live(t, "documents").select(c("doc_id").alias("id"), c("doc_id").alias("created_at"), "text")
    stored = lambda: t.embeddings.select(c("vec_id").alias("id"))
    st.backfill(docs, stored, lambda rows: rows.select("id", F.length("text").alias("size")), root, 5000)
    return t.spark.read.schema("id bigint").parquet(f"{root}/vectors").select("id")


@query("t11_board_expiry", b.cte(b.TRACES, """
e as (select event_id as entry, ts + interval 5 day as expires_at, case when kind = 'purchase' then ts + interval 1 day end as resolved_at from traces), p as (select event_id as entry, ts + interval 40 day as pinned_until from traces where k % 9 = 0)""") + """
select e.entry, case when resolved_at <= timestamp '2024-01-20' then 'resolved' when expires_at > timestamp '2024-01-20' then 'open' when exists (select 1 from p where p.entry = e.entry and pinned_until > timestamp '2024-01-20') then 'retained' else 'expired' end as state from e""")
def t11(t):
    x = b.traces(t)
    entries = x.select(c("event_id").alias("entry"), (c("ts") + F.expr("interval 5 days")).alias("expires_at"), F.when(c("kind") == "purchase", c("ts") + F.expr("interval 1 day")).alias("resolved_at"))
    pins = x.where("k % 9 = 0").select(c("event_id").alias("entry"), (c("ts") + F.expr("interval 40 days")).alias("pinned_until"))
    return vw.board_state(entries, pins, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query("t11_pinned_stream", b.cte(b.TRACES) + """
select e.event_id as entry, p.event_id as pin from traces e join traces p on p.session = e.session and p.k % 10 = e.k % 10 and e.kind = 'signup' and p.kind = 'click' and p.ts >= e.ts and p.ts <= e.ts + interval 1 hour""")
def t11_stream(t):
    key = c("session") * 10 + c("k") % 10
    e = live_events(t).where("kind = 'signup'").select(key.alias("entry_id"), c("event_id").alias("entry"), c("time").alias("created_at"))
    p = live_events(t).where("kind = 'click'").select(key.alias("pin_entry"), c("event_id").alias("pin"), c("time").alias("pinned_at"))
    return st.run_to_table(st.expiries(e, p, "2 hours")).where("pin is not null").select("entry", "pin")


@query("t12_lease_intervals", b.cte(b.TRACES, """
l as (select k as entry, ts, event_id, session as actor, case when kind = 'purchase' then 'release' when kind in ('view', 'click') then 'claim' else 'heartbeat' end as action from traces),
w as (select *, lead(ts) over o as nt, lag(ts) over o as pt, lag(actor) over o as pa, lag(action) over o as px from l window o as (partition by entry order by ts, event_id))""") + """
select entry, event_id, actor, ts as held_from, least(ts + interval 1800 second, coalesce(nt, ts + interval 1800 second)) as held_until, nt is null or nt > ts + interval 1800 second as lapsed,
  coalesce(action = 'claim' and px <> 'release' and pt + interval 1800 second > ts and pa <> actor, false) as contended from w where action <> 'release'""")
def t12(t):
    action = F.when(c("kind") == "purchase", "release").when(c("kind").isin("view", "click"), "claim").otherwise("heartbeat")
    log = b.traces(t).select(c("k").alias("entry"), "ts", "event_id", c("session").alias("actor"), action.alias("action"))
    return vw.lease_intervals(log, 1800)


@query("t12_lease_stream", b.cte(b.TRACES, """
l as (select k as entry, ts, event_id, session as actor, case when kind = 'purchase' then 'release' when kind in ('view', 'click') then 'claim' else 'heartbeat' end as action from traces),
w as (select *, lead(ts) over o as nt, lag(ts) over o as pt, lag(actor) over o as pa, lag(action) over o as px from l window o as (partition by entry order by ts, event_id)),
m as (select max(ts) - interval 1 hour as mark from events),
i as (select entry, event_id, actor, ts as held_from, least(ts + interval 1800 second, coalesce(nt, ts + interval 1800 second)) as held_until, nt is null or nt > ts + interval 1800 second as lapsed,
  coalesce(action = 'claim' and px <> 'release' and pt + interval 1800 second > ts and pa <> actor, false) as contended from w where action <> 'release')""") + """
select i.* from i, m where held_until <= mark""")
def t12_stream(t):
    """Lapses come from timers: an interval whose end the watermark has passed needs no later event."""
    action = F.when(c("kind") == "purchase", "release").when(c("kind").isin("view", "click"), "claim").otherwise("heartbeat")
    log = live_events(t).select(c("k").cast("bigint").alias("entry"), c("time").alias("ts"), "event_id", c("session").alias("actor"), action.alias("action"))
    out = st.run_to_table(ordered.lease_stream(log, 1800, "1 hour"))
    return out.withColumns({"entry": c("entry").cast("int"), **{x: c(x).cast("timestamp_ntz") for x in ("held_from", "held_until")}})


@query("t13_serial_slots", b.cte("""e as (select user_id as channel, event_id as entry, floor(epoch(ts))::bigint as created, ceil(value * 400)::bigint as service from events),
w as (select *, coalesce(sum(service) over (partition by channel order by created, entry rows between unbounded preceding and 1 preceding), 0) as before from e)""") + """
select channel, entry, (max(created - before) over (partition by channel order by created, entry rows unbounded preceding) + before)::bigint as start, (max(created - before) over (partition by channel order by created, entry rows unbounded preceding) + before - created)::bigint as wait from w""")
def t13(t):
    e = t.events.select(c("user_id").alias("channel"), c("event_id").alias("entry"), F.unix_seconds(c("ts").cast("timestamp")).alias("created"), F.ceil(c("value") * 400).cast("bigint").alias("service"))
    return vw.serial_slots(e).select("channel", "entry", big("start"), big("wait"))


@query("t13_slot_stream", """
with e as (select user_id as channel, event_id as entry, epoch_us(ts) as created, (ceil(value * 400) * 1000000)::bigint as service from events),
w as (select *, coalesce(sum(service) over (partition by channel order by created, entry rows between unbounded preceding and 1 preceding), 0)::bigint as before from e),
s as (select channel, entry, created, (max(created - before) over (partition by channel order by created, entry rows unbounded preceding) + before)::bigint as start from w),
n as (select *, lead(entry) over (partition by channel order by created, entry) as ne, lead(created) over (partition by channel order by created, entry) as nc from s)
select channel, entry, start, start - created as wait, case when nc < start then ne end as next from n, (select epoch_us(max(ts)) - 3600000000 as mark from events) where start <= mark""")
def t13_stream(t):
    e = live_events(t).select(c("session").alias("channel"), c("event_id").alias("entry"), c("time").alias("created"), (F.ceil(c("value") * 400) * 1_000_000).cast("bigint").alias("service"))
    return st.run_to_table(ordered.slot_stream(e, "1 hour"))


@query("t14_inbox_unseen", b.cte(b.TRACES) + """
select event_id as entry, k as recipient from traces where kind = 'view' and k in (select n_nationkey from nation) and (event_id, k) not in (select event_id - 1, k from traces where kind = 'click')
  and (event_id, k) not in (select event_id, k from traces where event_id % 4 = 0)""")
def t14(t):
    x = b.traces(t)
    entries = x.where("kind = 'view'").select(c("event_id").alias("entry"), c("k").alias("recipient"))
    acks = x.where("kind = 'click'").select((c("event_id") - 1).alias("entry"), c("k").alias("agent")).unionByName(x.where("event_id % 4 = 0").select(c("event_id").alias("entry"), c("k").alias("agent")))
    return vw.unseen(entries, acks, t.nation.select(c("n_nationkey").alias("agent")))


@query("t14_notice_coalescing", b.cte(b.TRACES) + "select session as recipient, kind as topic, arg_max(event_id, [epoch_us(ts), event_id]) as entry, count(*) as merged from traces group by 1, 2")
def t14_notices(t):
    n = b.traces(t).select(c("session").alias("recipient"), c("kind").alias("topic"), c("event_id").alias("entry"), c("ts").alias("created_at"))
    return vw.coalesced_notices(n)


@query("t15_presence", b.cte(b.TRACES, "r as (select session as agent, ts, case when kind = 'click' then 'busy' else 'idle' end as state, ts + interval 6 hour as expires_at from traces where ts <= timestamp '2024-01-20')") + """
select agent, max(ts) as last_seen, max(ts) + interval 7200 second >= timestamp '2024-01-20' as online, case max(case when expires_at > timestamp '2024-01-20' and state = 'busy' then 2 when expires_at > timestamp '2024-01-20' then 1 else 0 end) when 2 then 'busy' when 1 then 'idle' else 'unknown' end as state from r group by 1""")
def t15(t):
    now = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    r = b.traces(t).where(c("ts") <= now).select(c("session").alias("agent"), c("ts").alias("seen_at"), F.when(c("kind") == "click", "busy").otherwise("idle").alias("state"), (c("ts") + F.expr("interval 6 hours")).alias("expires_at"))
    return vw.presence(r, now, 7200)


@query("t16_coordination_fold", b.cte(b.TRACES, """
n as (select session as event, row_number() over (partition by session order by ts, event_id) as i, kind, k, event_id from traces),
ch as (select event, i + case when k % 30 = 0 then 1000 else 0 end as revision, case when k % 7 = 0 then i - 2 else i - 1 end as expected, case kind when 'error' then 'close' when 'signup' then 'reopen' when 'view' then 'approve' else 'note' end as action, k % 10 as approver from n),
p as (select *, coalesce(lag(revision) over (partition by event order by revision), 0) as prev from ch)""") + """
select event, max(revision) as revision, count(case when expected <> prev then 1 end) as stale, count(case when revision <> prev + 1 then 1 end) as gaps,
  coalesce(arg_max(case action when 'close' then 'ended' when 'reopen' then 'active' end, revision) filter (action in ('close', 'reopen')), 'active') as status, count(distinct case when action = 'approve' then approver end) as approvals from p group by 1""")
def t16(t):
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    n = b.traces(t).withColumn("i", F.row_number().over(w))
    action = F.when(c("kind") == "error", "close").when(c("kind") == "signup", "reopen").when(c("kind") == "view", "approve").otherwise("note")
    ch = n.select(
        c("session").alias("event"), (c("i") + F.when(c("k") % 30 == 0, 1000).otherwise(0)).alias("revision"), F.when(c("k") % 7 == 0, c("i") - 2).otherwise(c("i") - 1).alias("expected"),
        action.alias("action"), (c("k") % 10).alias("approved_by"),
    )
    return vw.coordination_fold(ch).select("event", big("revision"), "stale", "gaps", "status", "approvals")


SQL_CHANGES = """
n as (select session as event, row_number() over (partition by session order by ts, event_id) as revision, ts, kind, k::bigint as k from traces),
m as (select max(ts) - interval 1 hour as mark from events),
ch as (select event, revision, ts, case when k % 7 = 0 then revision - 2 else revision - 1 end as expected,
    case kind when 'error' then case when k % 2 = 0 then 'close' else 'reopen' end when 'purchase' then 'propose' when 'signup' then 'commit' when 'view' then 'agree' else case when k % 11 = 0 then 'withdraw' else 'note' end end as action,
    k % 5 as actor, k % 2 as proposal, case when k % 3 = 0 then 'discussion' else 'execution' end as target, case when k % 4 = 0 then [] else [k % 5, (k + 1) % 5] end as approvers, case when k % 8 = 0 then 1 else 0 end as expected_phase
  from n where k % 30 <> 0),
p as (select event, coalesce(max(case when ts <= mark then revision end), 0) as passed from ch, m group by 1),
q as (select ch.*, passed, row_number() over (partition by event, revision > passed order by revision) as j, row_number() over (partition by event order by revision) as i from ch join p using (event)),
r as (select * from q where revision <= passed or revision = passed + j),
f as (select distinct event, 0::bigint as i, 0::bigint as revision, false as gap, '' as outcome, false as ended, null::varchar as phase, 0::bigint as phase_revision,
    null::bigint as proposal, null::varchar as target, null::bigint as proposer, []::bigint[] as required, []::bigint[] as agreed from ch
  union all
  select event, i, revision, gap, outcome,
    case when outcome = 'applied' and action in ('close', 'reopen') then not ended else ended end,
    case when outcome = 'applied' and action = 'commit' then target else phase end,
    case when outcome = 'applied' and action = 'commit' then phase_revision + 1 else phase_revision end,
    case when outcome = 'applied' and action = 'propose' then new_proposal when outcome = 'applied' and action in ('withdraw', 'commit') then null else proposal end,
    case when outcome = 'applied' and action = 'propose' then new_target when outcome = 'applied' and action in ('withdraw', 'commit') then null else target end,
    case when outcome = 'applied' and action = 'propose' then actor when outcome = 'applied' and action in ('withdraw', 'commit') then null else proposer end,
    case when outcome = 'applied' and action = 'propose' then list_distinct(list_append(approvers, actor)) when outcome = 'applied' and action in ('withdraw', 'commit') then [] else required end,
    case when outcome = 'applied' and action = 'propose' then [actor] when outcome = 'applied' and action in ('withdraw', 'commit') then [] when outcome = 'applied' and action = 'agree' then list_distinct(list_append(agreed, actor)) else agreed end
  from (select f.event, r.i, r.revision, r.revision > f.revision + 1 as gap, r.action, r.actor, r.approvers, r.proposal as new_proposal, r.target as new_target,
      f.ended, f.phase, f.phase_revision, f.proposal, f.target, f.proposer, f.required, f.agreed,
      case when r.expected <> f.revision then 'stale' when action in ('close', 'reopen') then case when f.ended = (action = 'close') then 'rejected' else 'applied' end
        when action = 'note' then 'applied' when f.ended or r.expected_phase <> f.phase_revision then 'rejected'
        when action = 'propose' then case when f.proposal is not null or f.phase = r.target then 'rejected' else 'applied' end
        when f.proposal is null or f.proposal <> r.proposal then 'rejected'
        when action = 'agree' then case when list_contains(f.required, r.actor) then 'applied' else 'rejected' end
        when action = 'withdraw' then case when r.actor = f.proposer then 'applied' else 'rejected' end
        when len(list_filter(f.required, lambda x: not list_contains(f.agreed, x))) > 0 then 'rejected' else 'applied' end as outcome
    from f join r on r.event = f.event and r.i = f.i + 1) as step)"""


@query("t16_coordination_stream", b.cte(b.TRACES, SQL_CHANGES).replace("with ", "with recursive ", 1) + """
select event, revision, gap, outcome, case when ended then 'ended' else 'active' end as status, phase, phase_revision, len(agreed)::bigint as approvals from f where i > 0""")
def t16_stream(t):
    """The log is written once, in any order, and read as a stream; one change in thirty is lost."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    n = b.traces(t).withColumn("revision", F.row_number().over(w).cast("bigint")).withColumn("k", c("k").cast("bigint")).where("k % 30 <> 0")
    action = (
        F.when(c("kind") == "error", F.when(c("k") % 2 == 0, "close").otherwise("reopen")).when(c("kind") == "purchase", "propose").when(c("kind") == "signup", "commit")
        .when(c("kind") == "view", "agree").otherwise(F.when(c("k") % 11 == 0, "withdraw").otherwise("note"))
    )
    log = n.select(
        c("session").alias("event"), "revision", c("ts").cast("timestamp").alias("time"), (c("revision") - F.when(c("k") % 7 == 0, 2).otherwise(1)).alias("expected"), action.alias("action"),
        (c("k") % 5).alias("actor"), (c("k") % 2).alias("proposal"), F.when(c("k") % 3 == 0, "discussion").otherwise("execution").alias("target"),
        F.when(c("k") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c("k") % 5, (c("k") + 1) % 5)).alias("approvers"), F.when(c("k") % 8 == 0, 1).otherwise(0).cast("bigint").alias("expected_phase"),
    )
    root = st.stream_root(t.spark)
    log.repartition(8, F.xxhash64("event", "revision")).write.parquet(f"{root}/log")
    changes = t.spark.readStream.schema(log.schema).parquet(f"{root}/log")
    return st.run_to_table(ordered.coordination_stream(changes, "1 hour"))


@query("t17_run_facts", b.cte(b.TRACES, """
f as (select session as run, kind, k % 10 as task, k % 2 as attempt, min({'t': ts, 'e': event_id}) as m from traces group by 1, 2, 3, 4), s as (select *, row_number() over (partition by run order by m.t, m.e) as sequence from f)""") + """
select run, kind, task, attempt, m.e as fact, sequence from s""")
def t17(t):
    facts = b.traces(t).select(c("session").alias("run"), "kind", (c("k") % 10).alias("task"), (c("k") % 2).alias("attempt"), c("ts").alias("recorded_at"), c("event_id").alias("fact"))
    return vw.append_once(facts).select("run", "kind", "task", "attempt", "fact", big("sequence"))


@query("t18_ready_tasks", """
with tk as (select o_orderkey as task, o_orderkey % 4 as revision, case when o_orderkey % 5 = 0 then [] else [o_orderkey // 2, o_orderkey // 3] end as deps from orders where o_orderkey > 0),
ac as (select tk.task as dep from tk join (select o_orderkey as task, case when o_orderkey % 6 = 0 then 9 else o_orderkey % 4 end as revision from orders where o_orderstatus <> 'P') a on a.task = tk.task and a.revision = tk.revision),
x as (select task, u.d as dep from tk, unnest(deps) as u(d))
select tk.task, count(x.dep) = count(case when x.dep in (select dep from ac) then 1 end) as ready, count(x.dep) as dependencies from tk left join x on x.task = tk.task group by 1""")
def t18(t):
    k = c("o_orderkey")
    tasks = t.orders.where(k > 0).select(k.alias("task"), (k % 4).alias("revision"), F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.floor(k / 2), F.floor(k / 3))).alias("depends_on"))
    accepted = t.orders.where("o_orderstatus <> 'P'").select(k.alias("task"), F.when(k % 6 == 0, 9).otherwise(k % 4).alias("revision"))
    return vw.ready_tasks(tasks, accepted)


@query("t19_session_average", """
with r as (select vec_id % 20 as session, row_number() over (partition by vec_id % 20 order by vec_id) as i, count(*) over (partition by vec_id % 20) as n, embedding::double[] as e from embeddings),
p as (select session, u.p, sum(0.3 * pow(0.7, n - i) * e[u.p]) as x from r, range(1, 65) as u(p) group by 1, 2)
select session, round(sum(x), 6) as total, round(sum(x * p), 6) as weighted from p group by 1""")
def t19(t):
    w = Window.partitionBy("session").orderBy("vec_id")
    rows = t.embeddings.select((c("vec_id") % 20).alias("session"), "vec_id", "embedding").withColumn("ordinal", F.row_number().over(w)).select("session", "ordinal", F.col("embedding").cast("array<double>").alias("vector"))
    h = vw.session_average(rows, 0.3, 64)
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("h", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return h.select("session", F.round(total, 6).alias("total"), F.round(weighted, 6).alias("weighted"))


@query("t19_average_stream", """
with r as (select vec_id % 20 as session, vec_id, embedding::double[] as e from embeddings),
p as (select a.session, a.vec_id, sum(0.3 * pow(0.7, (select count(*) from r z where z.session = a.session and z.vec_id > y.vec_id and z.vec_id <= a.vec_id)) * list_sum(y.e)) as total from r a join r y on y.session = a.session and y.vec_id <= a.vec_id group by 1, 2)
select vec_id as event_id, round(total, 6) as total from p""")
def t19_stream(t):
    e = live(t, "embeddings").select((c("vec_id") % 20).alias("session"), c("vec_id").alias("event_id"), c("vec_id").alias("time"), "embedding").withColumnRenamed("embedding", "vector")
    return st.run_to_table(st.session_average(e, 0.3)).select("event_id", F.round("total", 6).alias("total"))
