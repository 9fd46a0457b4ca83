"""URL filters by a sort-merge range join over nested prefixes.

A rule's host, its labels reversed, is a prefix of the canonical keys of exactly the hosts it fits,
that is an interval of keys; a rule's path is an interval of paths. Keys and interval ends are sorted
together and swept: the start of an interval makes its rule the innermost one, its end brings back
the rule around it, and each key reads the innermost rule that is open. Intervals of prefixes nest,
so the rules around a rule (the stack below it) are the rules for shorter prefixes of its own.

The sweep runs in ranges of the sort order; what is open where a range begins comes from one summary
row per range. A host with a third of all pages spans several ranges, because the page breaks ties.

Cases: a null url, or one without ://, has empty host and path and no rule; a rule with null or empty
host fits nothing, a null path is an empty one and fits every path; equal rules count once, and of
equal rules with different verdicts block wins; equal pages are judged one by one; a host may hold
any number of rules, and rules and pages may have any other columns (those of pages are kept)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keelson.llm.common import free_name, stored
from keelson.registry import query

c = F.col


def url_host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot, as bytes: keys of subdomains begin with their domain's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def _past(prefix: Column) -> Column:
    """A bound above all keys with the prefix: no UTF-8 text holds a byte FF."""
    return F.concat(prefix, F.lit(b"\xff"))


def sweep(probes: DataFrame, prefixes: DataFrame, key: str, tie: Column, name: str) -> DataFrame:
    """Adds to each probe the struct ``name``: prefix and ``value`` of the longest prefix of its key.

    ``probes``: rows with a binary ``key``. ``prefixes``: prefix (distinct, binary), value, and outer
    (the next shorter prefix with its value, or null). Both are sorted together in ranges."""
    spark = probes.sparkSession
    at, rank, open_, part, last, carry = free_name(probes, "_at", "_rank", "_open", "_part", "_last", "_carry")
    held = F.struct("prefix", "value")
    starts = prefixes.select(c("prefix").alias(at), F.lit(1).alias(rank), F.struct(held.alias("now")).alias(open_), F.length("prefix").alias("_n"))
    ends = prefixes.select(_past(c("prefix")).alias(at), F.lit(0).alias(rank), F.struct(c("outer").alias("now")).alias(open_), (-F.length("prefix")).alias("_n"))
    asked = probes.select("*", c(key).alias(at), F.lit(2).alias(rank), F.lit(None).cast(starts.schema[open_].dataType).alias(open_), tie.alias("_n"))
    events = asked.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a range's number is kept in a stored table, so every later reading sees the same ranges
    dealt = stored(events.repartitionByRange(ranges, at, rank, "_n").withColumn(part, F.spark_partition_id()))
    order = [at, rank, "_n"]
    inside = Window.partitionBy(part).orderBy(*order)
    summary = dealt.where(c(rank) < 2).groupBy(part).agg(F.max_by(open_, F.struct(*order)).alias(last))
    across = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    numbers = spark.range(ranges).select(c("id").cast("int").alias(part)).join(summary, part, "left")
    carried = numbers.select(part, F.last(last, ignorenulls=True).over(across).alias(carry))
    seen = dealt.withColumn(open_, F.last(open_, ignorenulls=True).over(inside)).where(c(rank) == 2)
    joined = seen.join(F.broadcast(carried), part, "left")  # one row per range
    return joined.withColumn(name, F.coalesce(c(open_), c(carry))["now"]).select(*probes.columns, name)


def nested(rows: DataFrame, prefixes: Column) -> DataFrame:
    """``rows`` (prefix, value; distinct prefixes) with outer: the longest other prefix among ``prefixes``.

    ``prefixes`` lists the shorter prefixes of a row that may be rules, shortest first; it is as long
    as the row's own prefix has labels or characters."""
    exploded = rows.select("prefix", F.posexplode(prefixes).alias("_place", "_outer"))
    found = exploded.join(rows.select(c("prefix").alias("_outer"), c("value").alias("_value")), "_outer")
    longest = found.groupBy("prefix").agg(F.max_by(F.struct(c("_outer").alias("prefix"), c("_value").alias("value")), "_place").alias("outer"))
    return rows.join(longest, "prefix", "left")


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, or null) and verdict.

    ``rules``: host, path, verdict. Of two rules of equal length the one with the longer host wins."""
    names = free_name(pages, "_row", "_key", "_host", "_sub", "_fit", "_depth")
    row, key, host_hit, sub, fit, depth = names
    given = rules.select(
        F.translate(c("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).where("host is not null and host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = stored(given.withColumn("hostkey", host_key(c("host"))))

    # hosts of rules, each with the stack of rule hosts around it (at most one per label), itself first
    hosts = given.select(c("hostkey").alias("prefix"), "host").distinct().withColumn("labels", F.reverse(F.split("host", r"\.")))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.concat(F.array_join(F.slice("labels", 1, n), "."), F.lit(".")).cast("binary"))
    around = hosts.select("prefix", F.explode(suffixes).alias("_up")).join(hosts.select(c("prefix").alias("_up")), "_up")
    stacks = around.groupBy("prefix").agg(F.sort_array(F.collect_list("_up"), asc=False).alias("value"))
    outer_hosts = stacks.select(
        "prefix", "value", F.when(F.size("value") > 1, F.struct(F.get("value", F.lit(1)).alias("prefix"), F.slice("value", 2, F.size("value")).alias("value"))).alias("outer"),
    )

    # rules as prefixes of (host, path): the host's key ends where a null byte begins the path
    separator = F.lit(b"\x00")
    keyed = given.select(F.concat("hostkey", separator, c("path").cast("binary")).alias("prefix"), F.struct("host", "path", "verdict").alias("value"), "hostkey", "path")
    shorter = F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.concat(c("hostkey"), separator, F.substring(c("path"), F.lit(1), n - 1).cast("binary")))
    shorter = F.when(F.length("path") > 0, shorter).otherwise(F.array().cast("array<binary>"))
    outer_rules = nested(keyed, shorter).select("prefix", "value", "outer")

    base = pages.withColumns({"host": url_host(c(url)), "path": url_path(c(url))})
    probes = stored(base.withColumn(row, F.monotonically_increasing_id()).withColumn(key, host_key(c("host"))))
    asked = probes.where("host <> ''").select(row, "path", key)
    with_host = sweep(asked, outer_hosts, key, c(row), host_hit).where(c(host_hit).isNotNull())
    tried = with_host.select(row, F.explode(f"{host_hit}.value").alias(sub), "path")
    tried = tried.select(row, F.concat(c(sub), separator, c("path").cast("binary")).alias(key))
    fitted = sweep(tried, outer_rules, key, c(row), fit).where(c(fit).isNotNull()).select(row, f"{fit}.value.*")
    best = fitted.groupBy(row).agg(F.max_by(
        F.struct(F.concat("host", "path").alias("rule"), "verdict"),
        F.struct(F.length("host") + F.length("path"), F.length("host")),
    ).alias(fit))
    out = probes.join(best, row, "left")
    kept = [x for x in pages.columns if x.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", c(fit)["rule"].alias("rule"), F.coalesce(c(fit)["verdict"], F.lit(default)).alias("verdict"))


#: The rules of the registered query (fixed values): host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


OP6_SQL = r"""
with rules(rhost, rpath, rverdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (select page_id, coalesce(url, '') url, strpos(coalesce(url, ''), '://') p from pages),
rest as (select page_id, case when p > 0 then substr(url, p + 3) else '' end r from cut),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
fits as (
  select page_id, max_by(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost || rpath) * 1000 + length(rhost)) best
  from parts join rules on (host = rhost or suffix(host, '.' || rhost)) and prefix(path, rpath) group by page_id)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from parts left join fits using (page_id)
"""


@query("op6_url_rules", OP6_SQL)
def op6_url_rules(t):
    return match_rules(t.pages.select("page_id", "url"), rule_table(t.spark)).select("page_id", "host", "path", "rule", "verdict")
