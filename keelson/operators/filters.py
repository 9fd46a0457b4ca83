"""Row predicates of the record model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions import text as tx

c = F.col


def has_marker(kind: str) -> Column:
    return F.exists("markers", lambda m: m["kind"] == kind)


def session_allows(session: Column) -> Column:
    """Shared rows plus the caller's own session."""
    return c("session").isNull() | c("session").eqNullSafe(session)


def visible(session: Column, now: Column) -> Column:
    return (
        (c("status") == "active") & ~has_marker("forget") & session_allows(session)
        & (c("expires_at").isNull() | (c("expires_at") > now))
        & (c("valid_from").isNull() | (c("valid_from") <= now))
        & (c("valid_until").isNull() | (c("valid_until") > now))
    )


def searchable(session: Column, now: Column, historical: bool = False, actor: str | None = None, retained: bool = False) -> Column:
    """Visibility for search; the historical mode lifts status and validity only."""
    base = F.lit(True)
    if not retained:
        base = base & c("storage_state").isNull()
    if actor is not None:
        base = base & (c("source_actor") == actor)
    if not historical:
        return base & visible(session, now)
    return (
        base & (c("status") != "deleted") & ~has_marker("forget") & session_allows(session)
        & (c("expires_at").isNull() | (c("expires_at") > now))
    )


def in_event_window(event_time: Column, start: Column, end: Column) -> Column:
    """Inclusive bounds; a missing bound is open, a missing time never matches a bounded window."""
    unbounded = start.isNull() & end.isNull()
    return unbounded | F.coalesce(
        (start.isNull() | (event_time >= start)) & (end.isNull() | (event_time <= end)), F.lit(False)
    )


def scope_key(scope: Column) -> Column:
    """Order-free text form of a scope map, used for equality and grouping."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(scope))))


def scope_matches(scope: Column, required: Column) -> Column:
    """Every required key/value is present."""
    return F.forall(F.map_entries(required), lambda e: scope[e["key"]].eqNullSafe(e["value"]))


def scopes_overlap(left: Column, right: Column) -> Column:
    """No key constrained by both sides disagrees."""
    return ~F.exists(
        F.map_entries(left),
        lambda e: F.coalesce(F.try_element_at(right, e["key"]) != e["value"], F.lit(False)),
    )


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open overlap with missing ends unbounded; empty intervals never overlap."""
    sane = lambda s, e: s.isNull() | e.isNull() | (s < e)
    return (
        sane(a0, a1) & sane(b0, b1)
        & (a0.isNull() | b1.isNull() | (a0 < b1)) & (b0.isNull() | a1.isNull() | (b0 < a1))
    )


# Query intent families.
INTENTS = {
    "list_count": (r"\b(?:how many|how much|list|all|count)\b|(?:多少|几个|列出|全部)", ("derived", "event", "fact", "state")),
    "recommend": (r"\b(?:recommend|suggest|preference)\b|(?:推荐|建议|偏好)", ("preference", "constraint")),
    "assistant": (r"\b(?:assistant|you said|previous chat)\b|(?:你说过|助手|之前的对话)", ("conversation_evidence",)),
}


def intent(query: Column, family: str) -> Column:
    return query.rlike(INTENTS[family][0])


def default_residence(truth: Column, actor: Column, requested: Column) -> Column:
    """Derived, inferred and unverified assistant statements start provisional."""
    provisional = truth.isin("derived", "inferred") | ((actor == "assistant") & (truth != "verified"))
    return F.coalesce(requested, F.when(provisional, "stg").otherwise("ltg"))


def retention_state(now: Column, days: int = 365, importance: float = 0.25, accesses: int = 1) -> Column:
    """Recommended storage transition; open items are never moved."""
    idle = F.date_diff(now, F.coalesce(c("last_accessed_at"), c("created_at")))
    age = F.date_diff(now, c("created_at"))
    low = (c("importance") <= importance) & (c("access_count") <= accesses) & (c("status") == "active")
    openish = F.coalesce(c("resolution").isin("open", "reopened"), F.lit(False))
    return (
        F.when(openish | ~low, None)
        .when(c("storage_state").isNull() & (age >= days) & (idle >= days), "dormant")
        .when((c("storage_state") == "dormant") & (F.date_diff(now, c("retention_changed_at")) >= days), "quarantine")
    )


def normalize_claims(claims: Column) -> Column:
    """Trim and drop empty claims, clamp confidence, null the key of neutral claims."""
    kept = F.filter(claims, lambda x: F.trim(x["text"]) != "")
    polarity = lambda x: F.when(x["polarity"].isin("affirmative", "negative", "neutral"), x["polarity"])
    key = lambda x: F.when(
        (F.coalesce(polarity(x), F.lit("")) != "neutral") & (F.trim(x["predicateKey"]) != ""), F.lower(F.trim(x["predicateKey"]))
    )
    return F.transform(
        kept,
        lambda x: F.struct(
            F.trim(x["text"]).alias("text"), polarity(x).alias("polarity"), key(x).alias("predicateKey"),
            F.when(x["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["confidence"]))).alias("confidence"),
            x["extractMethod"].alias("extractMethod"),
        ),
    )


def representative_claim(claims: Column) -> Column:
    """First non-neutral claim, else the first claim."""
    decided = F.filter(claims, lambda x: x["polarity"].isin("affirmative", "negative"))
    return F.coalesce(F.get(decided, 0), F.get(claims, 0))


def normalize_markers(markers: Column) -> Column:
    """Trim kinds, drop blanks, sort attributes, drop exact repeats."""
    named = F.filter(markers, lambda m: F.coalesce(F.trim(m["kind"]), F.lit("")) != "")
    return F.array_distinct(
        F.transform(
            named,
            lambda m: F.struct(
                F.trim(m["kind"]).alias("kind"),
                F.array_sort(F.coalesce(F.map_entries(m["attributes"]), F.array())).alias("attributes"),
            ),
        )
    )


def recall_triggers(markers: Column, most: int = 16, longest: int = 80) -> Column:
    """Trigger phrases of a record: collapsed, bounded, distinct ignoring case (first spelling kept)."""
    marked = F.filter(markers, lambda m: m["kind"].isin("recall_trigger", "retrieveHint") & m["attributes"]["value"].isNotNull())
    phrases = F.filter(
        F.transform(marked, lambda m: F.trim(F.regexp_replace(m["attributes"]["value"], r"\s+", " "))),
        lambda p: (p != "") & (F.length(p) <= longest),
    )
    lowered = F.transform(phrases, F.lower)
    first = F.filter(phrases, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)
    return F.slice(first, 1, most)


def trigger_match(normal_query: Column, triggers: Column) -> Column:
    """Length of the longest trigger that occurs in the normalised query (0 when none)."""
    spaced = F.concat(F.lit(" "), normal_query, F.lit(" "))
    hits = F.filter(
        triggers,
        lambda p: (F.length(p) >= 2)
        & F.when(p.rlike(r"\p{IsHan}"), normal_query.contains(p)).otherwise(spaced.contains(F.concat(F.lit(" "), p, F.lit(" ")))),
    )
    return F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))


def pure_acknowledgement(text: Column) -> Column:
    """At most five words, no digit, and no capitalised word after the first."""
    body = F.regexp_replace(text, r"^[^:]{1,20}:\s*", "")
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    tail = F.slice(words, 2, 10)
    return F.size(words).between(1, 5) & ~body.rlike(r"\d") & F.forall(tail, lambda w: ~w.rlike("^[A-Z]"))


def retain_slow(phases: DataFrame, trace: str, limit_ms: float = 1000.0) -> DataFrame:
    """All phases of the traces whose recall phase took longer than the limit."""
    slow = phases.where((c("phase") == "recall") & (c("elapsed_ms") > limit_ms)).select(trace).distinct()
    return phases.join(slow, trace, "left_semi")


def entity_filter(
    kind: str | None = None, ids: list | None = None, nodes: list | None = None, exact_text: str | None = None, contains: str | None = None,
    state_key: str | None = None, scope: str | None = None, exclude_scope: str | None = None, session: str | None = None, session_scoped: bool = False,
    connected_to: str | None = None, event_from=None, event_to=None,
) -> Column:
    """Conjunction of the given conditions of an entity scan, for pushdown to the source.

    Columns: kind, id, node, name, statement, state_key, scope, session, source, target, event_time;
    only those of the given conditions are read. Session-scoped kinds show rows of no session and of
    the asking one. A null never satisfies a condition. An empty id or node list matches nothing."""
    out = F.lit(True)
    if kind is not None:
        out &= c("kind") == kind
    if ids is not None:
        out &= c("id").isin(*ids) if ids else F.lit(False)
    if nodes is not None:
        out &= c("node").isin(*nodes) if nodes else F.lit(False)
    if exact_text is not None:
        out &= c("name") == tx.statement_form(F.lit(exact_text))
    if contains is not None:
        out &= c("statement").contains(contains)
    if state_key is not None:
        out &= c("state_key") == state_key
    if scope is not None:
        out &= c("scope") == scope
    if exclude_scope is not None:
        out &= c("scope") != exclude_scope
    if session_scoped:
        out &= (c("session") == "") | (c("session") == (session or ""))
    if connected_to is not None:
        out &= (c("source") == connected_to) | (c("target") == connected_to)
    if event_from is not None:
        out &= c("event_time") >= event_from
    if event_to is not None:
        out &= c("event_time") <= event_to
    return out


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next page of rows behind the values ``after`` of the order columns (unique together).

    The comparison is lexicographic and reaches the scan; a page is at most 512 rows."""
    if not 1 <= limit <= 512:
        raise ValueError("a page has 1 to 512 rows")
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            behind |= equal & (c(name) > value)
            equal &= c(name) == value
        rows = rows.where(behind)
    return rows.orderBy(*order).limit(limit)


def passes_advanced(types: Column, node_names: Column, state_keys: Column, event_from: Column, event_to: Column, exclude_terms: Column) -> Column:
    """Whether a candidate (memory_type, node, state_key, event_time, statement) passes a query's filters.

    A null filter is no filter. A row without an event time fails any time bound; a row without type
    or state key counts as the empty one; names and excluded terms are compared in lower case."""
    either = lambda given, test: given.isNull() | test
    node = F.lower(F.coalesce("node", F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("node", F.lit(""))))
    return (
        either(types, F.array_contains(types, F.coalesce("memory_type", F.lit(""))))
        & either(node_names, F.exists(node_names, lambda x: node.contains(F.lower(x))))
        & either(state_keys, F.array_contains(state_keys, F.coalesce("state_key", F.lit(""))))
        & either(event_from, F.coalesce(c("event_time") >= event_from, F.lit(False)))
        & either(event_to, F.coalesce(c("event_time") <= event_to, F.lit(False)))
        & either(exclude_terms, ~F.exists(exclude_terms, lambda x: text.contains(F.lower(x))))
    )
