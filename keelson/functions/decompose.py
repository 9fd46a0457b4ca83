"""Static decomposition of questions into sub-queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Function words of a question.
QUESTION_STOP_WORDS = (
    "a an the is are was were be been being do does did done have has had will would can could should may might of in "
    "on at to for from by with about as into and or but what which who whom whose where when why how that this these "
    "those it its his her their there here s"
).split()
# Words an answer to each question word tends to hold.
ASPECTS = {
    "where": "location place city country town moved lives visited trip".split(),
    "when": "date time year month week ago last before after birthday anniversary".split(),
    "who": "person friend name met knows recommended told".split(),
}


def content_words(question: Column) -> Column:
    cleaned = F.transform(F.split(question, r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}'-]", ""))
    return F.filter(cleaned, lambda t: (t != "") & ~F.lower(t).isin(QUESTION_STOP_WORDS))


def content_clause(question: Column) -> Column:
    """First ten content words; null when empty or no different from the question."""
    clause = F.array_join(F.slice(content_words(question), 1, 10), " ")
    return F.when((clause != "") & (F.lower(clause) != F.lower(question)), clause)


def aspect_clause(question: Column) -> Column:
    """Named entities plus the aspect words of the leading question word."""
    words = content_words(question)
    entities = F.filter(words, lambda t, i: (i > 0) & t.rlike("^[A-Z]"))
    wh = F.regexp_replace(F.lower(F.element_at(F.split(question, r"\s+"), 1)), r"\W", "")
    lowered = F.transform(entities, F.lower)
    chosen = None
    for word, terms in ASPECTS.items():
        clause = F.array_join(F.array_distinct(F.concat(lowered, F.array(*[F.lit(t) for t in terms]))), " ")
        chosen = F.when(wh == word, clause) if chosen is None else chosen.when(wh == word, clause)
    return chosen
