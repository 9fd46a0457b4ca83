"""Batch twins of the stream operators: the same results from a stored log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.operators import curation, expansion

c = F.col


# What makes a prompt a task, and what makes it a continuation. A word ends at any character but
# letters, digits and the underscore of ASCII, as in the SQL twins (Java's own \b takes "ö" for part of a word);
# without regard to case, the long s and the Kelvin sign are letters of ASCII there.
_WORD = r"\w\x{17F}\x{212A}"
_AS_WORD = r"(?<!\w)(?:%s)(?!\w)"
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # what trim() takes away there
TASK_WORDS = rf"(?iu)(?:[A-Za-z][{_WORD}.-]{{2,}}[-_/][{_WORD}./-]+|{_AS_WORD % 'fix|implement|debug|test|build|refactor|install|configure'}|(?:修复|实现|测试|构建|重构|安装|配置|设计))"
CONTINUATION_WORDS = rf"(?iu)(?:{_AS_WORD % 'continue|again|retry|reload|try|proceed|go on|fix it|test it'}|(?:继续|再试|重试|试试|开始吧|接着|改吧|修一下|好了|可以了|然后呢))"
CONTINUATION_ALONE = r"^(?:这次呢|试一下)[。！？?!，,]*$"


def prompt_kind(prompt: Column) -> tuple[Column, Column]:
    """The anchor that a substantive prompt gives (else null), and whether a prompt asks to go on."""
    flat = F.btrim(F.regexp_replace(prompt, r"[\t\n\f\r ]+", " "), F.lit(_SPACES))
    anchor = F.when((F.length(flat) >= 40) | flat.rlike(TASK_WORDS), F.substring(flat, 1, 480))
    return anchor, (F.length(flat) <= 100) & (flat.rlike(CONTINUATION_ALONE) | flat.rlike(CONTINUATION_WORDS))


def task_window(turns: DataFrame) -> DataFrame:
    """Continuation prompts with the two latest substantive prompts of their session, older first.

    ``turns``: session, ordinal, prompt. A prompt that repeats the latest anchor is no new one.
    """
    anchor, again = prompt_kind(c("prompt"))
    staged = turns.withColumns({"anchor": anchor, "again": again})
    before = expansion.carry_forward(staged, "session", "ordinal", "anchor", "latest")
    fresh = c("anchor").isNotNull() & ~c("anchor").eqNullSafe(c("latest"))
    paired = before.withColumn("pair", F.when(fresh, F.concat_ws("\n", "latest", "anchor")))
    carried = expansion.carry_forward(paired, "session", "ordinal", "pair", "prior")
    continued = c("again") & c("prior").isNotNull()
    return carried.select("session", "ordinal", continued.alias("continued"), F.when(continued, c("prior")).alias("context"), c("anchor").isNotNull().alias("substantive"))


def lease_intervals(log: DataFrame, ttl_seconds: int) -> DataFrame:
    """Holder intervals of a claim / heartbeat / release log, with lapse and contention flags.

    ``log``: entry, ts, event_id, actor, action. A claim or heartbeat holds until the next event of
    the entry or its lease end, whichever is first.
    """
    near = curation.neighbours(log, ["entry"], ["ts", "event_id"], ["ts", "actor", "action"], F.to_date("ts"))  # an entry of any length is cut into days
    staged = near.withColumns({"next_ts": c("after.ts"), "prev_ts": c("before.ts"), "prev_actor": c("before.actor"), "prev_action": c("before.action")})
    lease_end = F.timestamp_add("SECOND", F.lit(ttl_seconds), c("ts"))
    live_before = (c("prev_action") != "release") & (F.timestamp_add("SECOND", F.lit(ttl_seconds), c("prev_ts")) > c("ts"))
    held = staged.where("action <> 'release'")
    return held.select(
        "entry", "event_id", "actor", c("ts").alias("held_from"), F.least(lease_end, F.coalesce("next_ts", lease_end)).alias("held_until"),
        (c("next_ts").isNull() | (c("next_ts") > lease_end)).alias("lapsed"),
        F.coalesce((c("action") == "claim") & live_before & (c("prev_actor") != c("actor")), F.lit(False)).alias("contended"),
    )


def serial_slots(entries: DataFrame) -> DataFrame:
    """Serial channels as a queue: when each entry becomes the outstanding one, and its wait.

    ``entries``: channel, entry, created (seconds), service (seconds). With one slot, start is
    max(created, previous end) = running max of (created - work before it) + work before it.
    """
    day, order = F.floor(c("created") / 86_400), ["created", "entry"]  # a channel of any length is cut into days
    summed = curation.running_sum(entries, ["channel"], order, {"service": "_through"}, day)
    staged = summed.withColumn("before", c("_through") - c("service")).withColumn("_slack", c("created") - c("before"))
    started = curation.running_max(staged, ["channel"], order, "_slack", "_wait", day).withColumn("start", c("_wait") + c("before"))
    return started.select("channel", "entry", "start", (c("start") - c("created")).alias("wait"))


def unseen(entries: DataFrame, deliveries: DataFrame, agents: DataFrame) -> DataFrame:
    """Directed entries an agent has neither received nor acknowledged.

    ``entries``: entry, recipient; ``deliveries``: entry, agent; ``agents``: agent (the audience).
    """
    addressed = entries.join(agents.withColumnRenamed("agent", "recipient"), "recipient", "left_semi")
    return addressed.join(deliveries.withColumnRenamed("agent", "recipient"), ["entry", "recipient"], "left_anti")


def coalesced_notices(notices: DataFrame) -> DataFrame:
    """Latest undelivered notice per coalescing key, with how many it stands for."""
    return notices.groupBy("recipient", "topic").agg(F.max_by("entry", F.struct("created_at", "entry")).alias("entry"), F.count("*").alias("merged"))


def presence(reports: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Online within the window; busy outranks idle among unexpired reports.

    ``reports``: agent, seen_at, state, expires_at.
    """
    live = c("expires_at") > now
    rank = F.max(F.when(live & (c("state") == "busy"), 2).when(live & (c("state") == "idle"), 1).otherwise(0))
    agg = reports.groupBy("agent").agg(F.max("seen_at").alias("last_seen"), rank.alias("r"))
    return agg.select(
        "agent", "last_seen", (F.timestamp_add("SECOND", F.lit(seconds), c("last_seen")) >= now).alias("online"),
        F.when(c("r") == 2, "busy").when(c("r") == 1, "idle").otherwise("unknown").alias("state"),
    )


def coordination_fold(changes: DataFrame) -> DataFrame:
    """Final state of event-sourced coordination rows, with stale and gap counts.

    ``changes``: event, revision, expected, action, approved_by. A change is stale when its expected
    revision is not the previous one; a gap is a jump in the revision sequence. The state is the
    last close or reopen, picked with ``max_by``.
    """
    near = curation.neighbours(changes, ["event"], ["revision"], ["revision"], F.floor(c("revision") / 4096))
    staged = near.withColumn("prev", F.coalesce(c("before.revision"), F.lit(0)))
    return staged.groupBy("event").agg(
        F.max("revision").alias("revision"), F.count_if(c("expected") != c("prev")).alias("stale"), F.count_if(c("revision") != c("prev") + 1).alias("gaps"),
        F.coalesce(F.max_by(F.when(c("action") == "close", "ended").when(c("action") == "reopen", "active"), F.when(c("action").isin("close", "reopen"), c("revision"))), F.lit("active")).alias("status"),
        F.count_distinct(F.when(c("action") == "approve", c("approved_by"))).alias("approvals"),
    )


def append_once(facts: DataFrame) -> DataFrame:
    """First fact per (run, kind, task, attempt), numbered in arrival order inside its run."""
    first = facts.groupBy("run", "kind", "task", "attempt").agg(F.min(F.struct("recorded_at", "fact")).alias("f")).select("run", "kind", "task", "attempt", "f.*")
    day = F.to_date("recorded_at")  # a run of any length is cut into days
    return curation.running_sum(first.withColumn("_one", F.lit(1)), ["run"], ["recorded_at", "fact"], {"_one": "sequence"}, day).drop("_one")


def ready_tasks(tasks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Tasks whose every dependency is accepted at its current revision.

    ``tasks``: task, revision, depends_on; ``accepted``: task, revision.
    """
    current = tasks.select("task", "revision").join(accepted, ["task", "revision"], "left_semi").select(c("task").alias("dep"), F.lit(1).alias("ok"))
    wanted = tasks.select("task", F.explode_outer("depends_on").alias("dep"))
    checked = wanted.join(current, "dep", "left")
    return checked.groupBy("task").agg(F.bool_and(c("dep").isNull() | c("ok").isNotNull()).alias("ready"), F.count("dep").alias("dependencies"))


def board_state(entries: DataFrame, pins: DataFrame, now: Column) -> DataFrame:
    """Entries as of ``now``: resolved, retained by a live pin, expired, or open."""
    pinned = pins.where(c("pinned_until") > now).select("entry").distinct().withColumn("pinned", F.lit(True))
    state = F.when(c("resolved_at").isNotNull() & (c("resolved_at") <= now), "resolved").when(c("expires_at") > now, "open").when(c("pinned"), "retained").otherwise("expired")
    return entries.join(pinned, "entry", "left").select("entry", state.alias("state"))


def session_average(rows: DataFrame, alpha: float, size: int) -> DataFrame:
    """Final moving-average vector per session, as a weighted sum.

    h_n = Σ alpha(1-alpha)^(n-i) x_i, so only each row's distance from its session's end is
    needed; the sum combines map-side per (session, position). ``rows``: session, ordinal, vector,
    with ordinals 1..n.
    """
    last = rows.groupBy("session").agg(F.max("ordinal").alias("n"))
    weighted = rows.join(last, "session").withColumn("w", alpha * F.pow(F.lit(1 - alpha), c("n") - c("ordinal")))
    parts = weighted.select("session", "w", F.posexplode("vector").alias("p", "x")).groupBy("session", "p").agg(F.sum(c("w") * c("x")).alias("x"))
    return parts.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("h"))
