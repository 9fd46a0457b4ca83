"""Event-time phrases as columns: start instant, granularity, window bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Month names, Han digits and day words with their offsets.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
DAY_WORDS = {
    "今天": 0, "今日": 0, "当天": 0, "昨天": -1, "昨日": -1, "昨晚": -1, "前天": -2, "前日": -2, "大前天": -3,
    "明天": 1, "明日": 1, "后天": 2, "后日": 2, "大后天": 3,
    "today": 0, "tonight": 0, "yesterday": -1, "tomorrow": 1,
}
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
SPANS = {"上": -1, "下": 1, "这": 0, "本": 0}
YEAR_SPANS = {"前": -2, "去": -1, "今": 0, "本": 0, "明": 1}


def _lookup(mapping: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def _clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    text = F.concat(
        F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "),
        F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":"), second,
    )
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def han_number(text: Column) -> Column:
    """Digits or Han numerals up to 99; null otherwise."""
    ten = F.instr(text, "十")
    high = F.when(ten == 1, 1).otherwise(_lookup(HAN_DIGITS, F.substring_index(text, "十", 1)))
    rest = F.substring_index(text, "十", -1)
    low = F.when(rest == "", 0).otherwise(_lookup(HAN_DIGITS, rest))
    return (
        F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
        .when(ten > 0, high * 10 + low)
        .when(F.length(text) == 1, _lookup(HAN_DIGITS, text))
    )


def _shift(day: Column, amount: Column, unit: str) -> Column:
    """Shift a calendar day; months and years snap to the start of theirs."""
    if unit == "day":
        return F.date_add(day, amount.cast("int")).cast("timestamp_ntz")
    grain = "month" if unit == "month" else "year"
    months = amount * (1 if unit == "month" else 12)
    return F.add_months(F.trunc(day, grain), months.cast("int")).cast("timestamp_ntz")


def parse_event_time(raw: Column, reference: Column) -> Column:
    """Struct(start timestamp_ntz, grain) of a date phrase; null when it does not resolve.

    ``reference`` is the source clock: it anchors relative phrases and dates without a year.
    """
    text = F.btrim(raw)
    low = F.lower(text)
    today = F.to_date(reference)
    result = F.lit(None)

    def made(start: Column, grain: str) -> Column:
        return F.struct(start.alias("start"), F.lit(grain).alias("grain"))

    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    slash = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:[ T](\d{1,2}):(\d{2}))?$"
    cjk_day = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]\s*(?:(\d{1,2})[:：](\d{2}))?$"
    cjk_bare = r"^(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]$"
    cjk_month = r"^(\d{4})\s*年\s*(\d{1,2})\s*月(?:份)?$"
    cjk_year = r"^(\d{4})\s*年$"
    en_day = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    en_month = r"^([A-Za-z]{3,9})\.?\s+(\d{4})$"
    week_day = r"^(上|下|这|本)(?:个)?(?:周|星期|礼拜)([一二三四五六日天])$"
    week = r"^(上|下|这|本)(?:个)?(?:周|星期|礼拜)$"
    month = r"^(上|下|这|本)(?:个)?月(?:份)?$"
    year = r"^(前|去|明|今|本)年$"
    offset = r"^(\d+|[一二三四五六七八九十两]+)\s*(小时|天|日|周|星期|礼拜|个月|月|年)(前|后|以前|以后)$"
    en_ago = r"^(\d+)\s+(hour|day|week|month|year)s?\s+ago$"
    en_span = r"^(last|this|next)\s+(day|week|month|year)$"

    def g(pattern: str, i: int, source: Column = text) -> Column:
        return _group(source, pattern, i)

    def dated(pattern: str) -> Column:
        timed = g(pattern, 4) != ""
        second = F.when(g(pattern, 6) != "", g(pattern, 6)).otherwise("00") if pattern == iso else F.lit("00")
        clock = _clock(g(pattern, 1), g(pattern, 2), g(pattern, 3), g(pattern, 4), g(pattern, 5), second)
        if pattern == iso:
            zone = g(iso, 7)
            sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
            digits = F.regexp_replace(zone, r"\D", "")
            minutes = F.coalesce(
                F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"), F.lit(0)
            )
            clock = F.timestamp_add("MINUTE", -sign * minutes, clock)
        start = F.when(timed, clock).otherwise(_day(g(pattern, 1), g(pattern, 2), g(pattern, 3)))
        return F.struct(start.alias("start"), F.when(timed, "minute").otherwise("day").alias("grain"))

    this_year = F.year(today).cast("string")
    same = _day(this_year, g(cjk_bare, 1), g(cjk_bare, 2))
    earlier = _day((F.year(today) - 1).cast("string"), g(cjk_bare, 1), g(cjk_bare, 2))
    bare = F.when(same <= today.cast("timestamp_ntz"), same).otherwise(earlier)

    def month_number(pattern: str) -> Column:
        names = {name: i + 1 for i, name in enumerate(MONTHS)}
        return _lookup(names, F.substring(F.lower(g(pattern, 1)), 1, 3)).cast("string")

    monday = F.weekday(today)
    amount = han_number(g(offset, 1)) * F.when(g(offset, 3).isin("前", "以前"), -1).otherwise(1)
    unit = g(offset, 2)
    ago = -g(en_ago, 1, low).try_cast("int")
    step = _lookup({"last": -1, "this": 0, "next": 1}, g(en_span, 1, low))
    hours_from = lambda n: F.timestamp_add("HOUR", n, reference)

    def english(count: Column, kind: Column) -> Column:
        return (
            F.when(kind == "hour", made(hours_from(count), "minute"))
            .when(kind == "month", made(_shift(today, count, "month"), "month"))
            .when(kind == "year", made(_shift(today, count, "year"), "year"))
            .when(kind == "week", made(_shift(today, count * 7, "day"), "day"))
            .otherwise(made(_shift(today, count, "day"), "day"))
        )

    result = (
        F.when(text.rlike(iso), dated(iso))
        .when(text.rlike(slash), dated(slash))
        .when(text.rlike(cjk_day), dated(cjk_day))
        .when(text.rlike(cjk_bare), made(bare, "day"))
        .when(text.rlike(cjk_month), made(_day(g(cjk_month, 1), g(cjk_month, 2), F.lit("1")), "month"))
        .when(text.rlike(cjk_year), made(_day(g(cjk_year, 1), F.lit("1"), F.lit("1")), "year"))
        .when(text.rlike(en_day), made(_day(g(en_day, 3), month_number(en_day), g(en_day, 2)), "day"))
        .when(text.rlike(en_month), made(_day(g(en_month, 2), month_number(en_month), F.lit("1")), "month"))
        .when(text.rlike(r"^(?:刚才|刚刚|这会儿|现在)$"), made(reference, "minute"))
        .when(low.isin(*DAY_WORDS), made(_shift(today, _lookup(DAY_WORDS, low), "day"), "day"))
        .when(
            text.rlike(week_day),
            made(_shift(today, _lookup(SPANS, g(week_day, 1)) * 7 + _lookup(WEEKDAYS, g(week_day, 2)) - monday, "day"), "day"),
        )
        .when(text.rlike(week), made(_shift(today, _lookup(SPANS, g(week, 1)) * 7 - monday, "day"), "day"))
        .when(text.rlike(month), made(_shift(today, _lookup(SPANS, g(month, 1)), "month"), "month"))
        .when(text.rlike(year), made(_shift(today, _lookup(YEAR_SPANS, g(year, 1)), "year"), "year"))
        .when(text.rlike(offset) & (unit == "小时"), made(hours_from(amount), "minute"))
        .when(text.rlike(offset) & unit.isin("天", "日"), made(_shift(today, amount, "day"), "day"))
        .when(text.rlike(offset) & unit.isin("周", "星期", "礼拜"), made(_shift(today, amount * 7, "day"), "day"))
        .when(text.rlike(offset) & unit.isin("月", "个月"), made(_shift(today, amount, "month"), "month"))
        .when(text.rlike(offset), made(_shift(today, amount, "year"), "year"))
        .when(low.rlike(en_ago), english(ago, g(en_ago, 2, low)))
        .when(low.rlike(en_span), english(step, g(en_span, 2, low)))
    )
    return result


def parse_phrases(phrases: Column, reference: Column) -> Column:
    """Array of struct(start, grain, end) for an array of phrases; unresolved ones have a null start.

    The lambda body holds the parse expression once, however many phrases a row carries.
    """
    parsed = F.transform(phrases, lambda p: parse_event_time(p, reference))
    return F.transform(
        parsed, lambda v: F.struct(v["start"].alias("start"), v["grain"].alias("grain"), window_end(v).alias("end"))
    )


def window_end(parsed: Column) -> Column:
    """Last millisecond of the phrase's grain."""
    start, grain = parsed["start"], parsed["grain"]
    day = F.to_date(start)
    last = (
        F.when(grain == "day", day)
        .when(grain == "month", F.last_day(day))
        .otherwise(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    )
    closing = F.timestamp_add("MILLISECOND", F.lit(86_399_999), last.cast("timestamp_ntz"))
    return F.when(grain == "minute", start).otherwise(closing)


# Date mentions inside English and Chinese query text.
DATE_TOKEN = (
    r"[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}|\d{4}-\d{1,2}-\d{1,2}"
    r"|\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*[日号]|\d{1,2}\s*月\s*\d{1,2}\s*[日号]|[A-Za-z]{3,9}\.?\s+\d{4}"
)
RELATIVE_TOKEN = (
    r"(?:大前天|大后天|今天|今日|昨天|昨日|前天|前日|明天|明日|后天|后日|刚才|刚刚"
    r"|(?:上|下|这|本)(?:个)?(?:周|星期|礼拜)[一二三四五六日天]|(?:上|下|这|本)(?:个)?(?:周|星期|礼拜|月)"
    r"|(?:前|去|明|今|本)年"
    r"|(?:\d+|[一二三四五六七八九十两]+)\s*(?:小时|天|日|周|星期|礼拜|个月|月|年)(?:前|后|以前|以后))"
)
DAY_TOKEN = (
    r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*[日号]|\d{1,2}\s*月\s*\d{1,2}\s*[日号])"
)
TEMPORAL_INTENT = (
    "什么时候|啥时候|何时|什么时间|哪天|哪一天|几号|哪个月|哪年|多久|多长时间|什么|啥|干了|做过|发生了什么"
    "|之前|之后|以前|以后|期间|当时|那天|那阵|最近|这阵子|从.*到"
)


def with_event_window(df: DataFrame, query: str, reference: str) -> DataFrame:
    """Add ``window_from`` / ``window_to`` named by the query text (both null when it names none).

    Each mention is parsed once into its own column; the choice between them is a cheap chain.
    """
    text, clock = F.col(query), F.col(reference)
    token = f"({RELATIVE_TOKEN}|{DAY_TOKEN})"
    patterns = {
        "_r": rf"(?i)\b(?:from|between)\s+({DATE_TOKEN}),?\s+(?:to|and)\s+({DATE_TOKEN})\b",
        "_u": rf"(?i)\b(?:as of|as at|by|before|until|up to)\s+({DATE_TOKEN})\b",
        "_o": rf"(?i)\bon\s+({DATE_TOKEN})\b",
        "_s": rf"(?i)\b(?:after|since)\s+({DATE_TOKEN})\b",
        "_h": rf"(?:从|自)?\s*{token}\s*(?:到|至|~|-|—)\s*{token}",
        "_c": token,
    }
    keys = ["_r1", "_r2", "_u1", "_o1", "_s1", "_h1", "_h2", "_c1"]
    mentions = [F.regexp_extract(text, patterns[k[:2]], int(k[2])) for k in keys]
    found = df.withColumn("_c1", F.regexp_extract(text, token, 1))
    parsed = found.withColumn("_p", parse_phrases(F.array(*mentions), clock))
    c = F.col
    start = {k: c("_p")[i]["start"] for i, k in enumerate(keys)}
    end = {k: c("_p")[i]["end"] for i, k in enumerate(keys)}
    ok = {k: start[k].isNotNull() for k in keys}
    hit = c("_c1")
    tail = F.expr(f"substring({query}, locate(_c1, {query}) + length(_c1))")
    rest = F.regexp_replace(F.replace(text, hit, F.lit("")), r"[的了呢吧啊？?。，,、!！\s]", "")
    binds = hit.rlike(f"^{RELATIVE_TOKEN}$") | text.rlike(TEMPORAL_INTENT) | (F.length(rest) <= 2)
    single = (hit != "") & ok["_c1"] & binds
    before, after = tail.rlike("之前|以前"), tail.rlike("之后|以后|以来")
    ranged, han = ok["_r1"] | ok["_r2"], ok["_h1"] | ok["_h2"]
    window_from = (
        F.when(ranged, start["_r1"]).when(ok["_u1"], None).when(ok["_o1"], start["_o1"]).when(ok["_s1"], start["_s1"])
        .when(han, start["_h1"]).when(single & ~before, start["_c1"])
    )
    window_to = (
        F.when(ranged, end["_r2"]).when(ok["_u1"], end["_u1"]).when(ok["_o1"], end["_o1"]).when(ok["_s1"], None)
        .when(han, end["_h2"]).when(single & (before | ~after), end["_c1"])
    )
    return parsed.withColumns({"window_from": window_from, "window_to": window_to}).drop("_c1", "_p")
