"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Cases: a null text has no words and fails the base rule; an empty text likewise. Equal rows are
judged one by one and alike. Columns of the input with the name of a metric give way to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keelson.llm.common import SPACE
from keelson.registry import query

#: Common function words of the languages served (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it with as on by at from this be are was or an he they you not have had "
    "la de et le les des un une est que qui en du dans pour pas sur au par il elle "
    "el los las y del se por con su para una lo como más o si es al "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch aus bei"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; a null bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The thresholds; every row becomes one conjunct of the verdict.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.6),
    Rule("mean_line_words", 3.0, None),
    Rule("alphabetic_ratio", 0.6, None),
)


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are hashed; if all hashes differ there is no repeat. Otherwise (hash, place) is sorted
    and neighbours of equal hash are compared word by word; the places of repeats, back in order,
    cover min(3, distance to the next) words each: n log n for any text."""
    n = F.size(words)

    def bound(value: Column, use) -> Column:
        """An array of one element gives a costly value a name inside the expression."""
        return F.element_at(F.transform(F.array(value), use), 1)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def alike(a: Column, b: Column) -> Column:
        same = [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)]
        return (a["h"] == b["h"]) & same[0] & same[1] & same[2]

    def repeats(s: Column) -> Column:
        later = F.transform(s, lambda x, i: F.coalesce(alike(x, F.get(s, i + 1)), F.lit(False)))
        return bound(later, lambda m: F.sort_array(F.filter(
            F.transform(s, lambda x, i: F.when(F.get(m, i) | F.coalesce(F.get(m, i - 1), F.lit(False)), x["i"])), lambda x: x.isNotNull()
        )))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == n - 2, F.lit(0).cast("bigint")).otherwise(bound(bound(placed, repeats), covered))

    return F.when(n >= 3, bound(hashes, counted)).otherwise(F.lit(0)).cast("bigint")


def quality_metrics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics of each text as columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = {x.lower() for x in documents.columns}
    words, lines, said = "_words", "_lines", "_text"
    while names & {words, lines, said}:
        words, lines, said = "_" + words, "_" + lines, "_" + said
    w, ls, t = F.col(words), F.col(lines), F.col(said)
    split = documents.withColumn(said, body).withColumns({
        words: F.array_remove(F.split(t, SPACE), ""),
        lines: F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0),
    })
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    counts = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"),
        "n_repeat_words": _repeated(w),
        "n_lines": F.size(ls).cast("bigint"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("bigint"),
        "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("bigint"),
    }
    counted = split.withColumns(counts).drop(words, lines, said)
    return counted.withColumns({
        "mean_word_chars": per(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": per(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": per(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": per(F.col("n_dup_lines"), F.col("n_lines")),
        "upper_ratio": per(F.col("n_upper"), F.col("n_letters")),
        "mean_line_words": per(F.col("n_words"), F.col("n_lines")),
        "alphabetic_ratio": per(F.col("n_letters"), F.col("word_chars")),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of all thresholds."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out &= F.col(r.metric) >= r.low
        if r.high is not None:
            out &= F.col(r.metric) <= r.high
    return out


def quality_rules(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed`` (under 50 words, or over half of them in repeated windows) and ``kept``."""
    measured = quality_metrics(documents, text).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    return measured.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def _sql_verdict(rules: tuple[Rule, ...] = RULES) -> str:
    """The thresholds as SQL for the oracle."""
    return " and ".join(f"{r.metric} {op} {bound!r}" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)


OP8_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from w, unnest(range(1, len(ws) - 1)) u(i)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) n from r, (values (0), (1), (2)) v(k) group by doc_id),
m as (select doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words,
  len(ls) n_lines, len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) n_stop_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) n_letters from w left join c using (doc_id)),
q as (select *, coalesce(word_chars / nullif(n_words, 0), 0) mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) symbol_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) dup_line_ratio,
  coalesce(n_upper / nullif(n_letters, 0), 0) upper_ratio, coalesce(n_words / nullif(n_lines, 0), 0) mean_line_words, coalesce(n_letters / nullif(word_chars, 0), 0) alphabetic_ratio, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_sql_verdict()} as kept from q
"""


@query("op8_quality_rules", OP8_SQL)
def op8_quality_rules(t):
    judged = quality_rules(t.documents.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
