"""Line dedup by content-defined chunks of lines.

The boundaries between chunks depend on lines alone, so an inserted line moves only the nearest one:
a rolling hash over the hashes of the last lines cuts after a line, and a line of many words is cut
off on both sides. A chunk whose hash occurs earlier in the corpus (order: doc_id, hash of the text,
place) is a candidate; it is removed if it has several lines, or lies in a run of candidates of over
fifty words. Chunks at the edges of a passage hold lines from outside, so candidates, and single lines
of some words, are seeds as well: around a seed the lines are compared one by one with those around
its first occurrence, and a stretch of equal lines of over fifty words is removed. What is removed
equals the first occurrence in length and SHA-256, taken over its bytes. First occurrences stay.

Cases: a null text stays null, an empty one empty; a text of which every chunk occurs earlier
becomes empty; rows equal in doc_id and text are one document and treated alike; null ids come first
in the order; lines are kept byte for byte, other columns unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.llm.common import SPACE, free_name, stored
from keelson.registry import query

c = F.col

ROLL = 2  # lines in the rolling hash
DIVISOR = 2  # a rolling hash divisible by this cuts
LONG_WORDS = 20  # a line of so many words is a chunk by itself
RUN_WORDS = 50  # a run of repeated chunks of more words is a passage
CHUNK_WORDS = 10  # a chunk of several lines needs so many words
SEED_WORDS = 5  # a line of so many words is a seed beside the chunks
SHIFT_WORDS = 10  # seeds of fewer words that stand as far from their first occurrences are not followed


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), ""))


def _bound(value: Column, use) -> Column:
    """An array of one element gives a costly value a name inside the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    """Array of (h, words) over the lines of a text."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).alias("words")))


def seeds_of(line: Column) -> Column:
    """Array of (start, len, words, h) over the chunks and the single lines of some words; start counts lines from one."""

    def begins(i: Column) -> Column:  # whether a chunk begins at place i, from zero
        before, here = F.get(line, i - 1), F.get(line, i)
        rolling = F.xxhash64(*[F.get(line, i - k)["h"] for k in range(ROLL, 0, -1)])
        return (i == 0) | (before["words"] >= LONG_WORDS) | (here["words"] >= LONG_WORDS) | (F.pmod(rolling, F.lit(DIVISOR)) == 0)

    def seed(start: Column, length: Column, chunk: Column) -> Column:
        part = F.slice(line, start, length)
        words = F.aggregate(part, F.lit(0), lambda a, x: a + x["words"])
        h = F.xxhash64(F.transform(part, lambda x: x["h"]))
        return F.struct(chunk.alias("idx"), start.cast("int").alias("start"), length.cast("int").alias("len"), words.alias("words"), h.alias("h"))

    def chunks(at: Column) -> Column:
        return F.transform(at, lambda start, k: seed(start + 1, F.coalesce(F.get(at, k + 1), F.size(line)) - start, k))

    places = F.filter(F.sequence(F.lit(1), F.size(line)), lambda i: F.get(line, i - 1)["words"] >= SEED_WORDS)
    singles = F.transform(places, lambda i: seed(i, F.lit(1), F.lit(None).cast("int")))
    return F.concat(_bound(F.filter(F.sequence(F.lit(0), F.size(line) - 1), begins), chunks), singles)


def equal_runs(here: Column, there: Column, shift: Column) -> Column:
    """Array of (start, len, words): the longest stretches of lines ``here`` that equal those ``shift`` places on ``there``."""
    low, high = F.greatest(F.lit(1), 1 - shift), F.least(F.size(here), F.size(there) - shift)

    def runs(breaks: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(breaks) - 2), lambda k: F.struct((F.get(breaks, k) + 1).alias("start"), (F.get(breaks, k + 1) - F.get(breaks, k) - 1).alias("len")))
        return F.transform(
            F.filter(each, lambda x: x["len"] > 0),
            lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), F.aggregate(F.slice(here, x["start"], x["len"]), F.lit(0), lambda a, y: a + y["words"]).alias("words")),
        )

    differs = F.filter(F.sequence(low, high), lambda i: F.get(here, i - 1)["h"] != F.get(there, i - 1 + shift)["h"])
    return F.when(low <= high, _bound(F.concat(F.array(low - 1), differs, F.array(high + 1)), runs))


def _same(left: DataFrame, right: DataFrame, own: tuple[str, str] = ("_id", "_th"), other: tuple[str, str] = ("_id", "_th")) -> Column:
    return left[own[0]].eqNullSafe(right[other[0]]) & (left[own[1]] == right[other[1]])


def repeated_lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The stretches of lines to remove: _id, _th (hash of the text), start, len; they may overlap."""
    whole = documents.where(c(text).isNotNull()).select(c(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), c(text).alias("_text"))
    # rows equal in id and text are one document
    lines = stored(whole.select("_id", "_th", lines_of(c("_text")).alias("line")).groupBy("_id", "_th").agg(F.any_value("line").alias("line")))
    seeds = stored(lines.select("_id", "_th", F.inline(seeds_of(c("line")))))
    firsts = stored(
        seeds.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "start", "len")).alias("first")).where("n > 1")
        .select("h", c("first._id").alias("f_id"), c("first._th").alias("f_th"), c("first.start").alias("f_start"))
    )
    itself = c("_id").eqNullSafe(c("f_id")) & (c("_th") == c("f_th")) & (c("start") == c("f_start"))
    later = stored(seeds.join(firsts, "h").where(~itself))

    # chunks of several lines go by themselves; chunks that follow one another if they make a passage
    chunks = later.where("idx is not null")
    run = Window.partitionBy("_id", "_th").orderBy("idx")
    numbered = chunks.withColumn("run", c("idx") - F.row_number().over(run))
    total = F.sum("words").over(Window.partitionBy("_id", "_th", "run"))
    by_chunk = numbered.withColumn("total", total).where((c("total") > RUN_WORDS) | (c("len") > 1) & (c("words") >= CHUNK_WORDS))

    # around the seeds, lines are compared one by one with those around the first occurrence, or around the
    # one before in the same text, so that a line that fills a text is followed once
    before = F.lag("start").over(Window.partitionBy("_id", "_th", "h").orderBy("start"))
    near = later.withColumn("before", before).select(
        "_id", "_th", "words", *[F.when(c("before").isNull(), c(x)).otherwise(c(y)).alias(x) for x, y in (("f_id", "_id"), ("f_th", "_th"))],
        (F.coalesce("before", "f_start") - c("start")).alias("shift"),
    )
    own = c("f_id").eqNullSafe(c("_id")) & (c("f_th") == c("_th")) & (c("shift") == 0)  # a line that is a chunk is a seed twice
    shifts = stored(near.where(~own).groupBy("_id", "_th", "f_id", "f_th", "shift").agg(F.sum("words").alias("words")).where(c("words") >= SHIFT_WORDS).drop("words"))
    here = shifts.join(lines, _same(shifts, lines)).select(*[shifts[x] for x in shifts.columns], "line")
    other = lines.select(c("_id").alias("o_id"), c("_th").alias("o_th"), c("line").alias("o_line"))
    both = here.join(other, _same(here, other, ("f_id", "f_th"), ("o_id", "o_th")))
    found = both.select("_id", "_th", "f_id", "f_th", "shift", F.explode(equal_runs(c("line"), c("o_line"), c("shift"))).alias("x")).where(c("x.words") > RUN_WORDS)
    by_line = found.select("_id", "_th", "x.start", "x.len", "f_id", "f_th", (c("x.start") + c("shift")).alias("f_start"))
    chosen = stored(by_chunk.select(*by_line.columns).unionByName(by_line).withColumn("h", F.xxhash64("f_id", "f_th", "f_start", "len")).distinct())

    # byte comparison: the texts of the chosen stretches and of their first occurrences
    used = chosen.select(c("f_id").alias("_id"), c("f_th").alias("_th"), c("f_start").alias("start"), "len", "h", F.lit(True).alias("is_first")).distinct()
    asked = chosen.select("_id", "_th", "start", "len", "h", F.lit(False).alias("is_first")).unionByName(used)
    wanted = asked.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "len", "h", "is_first")).alias("want"))  # stretches of one document
    one_each = whole.join(wanted, _same(whole, wanted)).select(wanted["_id"], wanted["_th"], "_text", "want")
    read = one_each.select("_id", "_th", F.split("_text", "\n").alias("lines"), F.explode("want").alias("w"))
    body = F.array_join(F.slice("lines", c("w.start"), c("w.len")), "\n")
    texts = stored(read.select("_id", "_th", "w.*", F.sha2(body.cast("binary"), 256).alias("body"), F.length(body).alias("chars")))
    first_texts = stored(texts.where("is_first").groupBy("h").agg(F.min(F.struct("body", "chars")).alias("first")))
    same = texts.where("not is_first").join(first_texts, "h").where((c("body") == c("first.body")) & (c("chars") == c("first.chars")))
    return same.select("_id", "_th", "start", "len")


def line_dedup(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns with the text shortened, and n_lines and n_removed_lines added."""
    id_, th, spans = free_name(documents, "_id", "_th", "_gone")
    gone = stored(repeated_lines(documents, text, doc_id)).groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "len")).alias(spans))
    left = documents.withColumns({id_: c(doc_id), th: F.xxhash64(text)})
    joined = left.join(gone, left[id_].eqNullSafe(gone["_id"]) & (left[th] == gone["_th"]), "left")
    lines = F.split(c(text), "\n")
    taken = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    shorter = _bound(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ls)), taken), lambda i: F.element_at(ls, i)), "\n"))
    removed = F.coalesce(F.size(taken), F.lit(0)).cast("bigint")
    keep = [x for x in documents.columns if x.lower() not in ("n_lines", "n_removed_lines")]
    return joined.select(
        *[F.when(c(spans).isNull(), c(text)).otherwise(shorter).alias(x) if x == text else left[x] for x in keep],
        F.when(c(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), F.when(c(spans).isNull(), F.lit(0).cast("bigint")).otherwise(removed).alias("n_removed_lines"),
    )


@query("op9_line_chunks")
def op9_line_chunks(t):
    return line_dedup(t.documents.select("doc_id", "text"))
