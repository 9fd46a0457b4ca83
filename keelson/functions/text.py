"""Text columns: normal forms, tokenisers, n-grams and lexical scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# English words a search query drops.
SEARCH_STOP_WORDS = (
    "an and are at be been being between but by did do does for from had has have how if in into "
    "is many much of on or the then to was were what when where which who whom whose why with"
).split()

# Words that carry no attribution signal.
FEEDBACK_STOP_WORDS = (
    "the and for that with was this his her you your they them are were from have has had not but "
    "all any can will would could about into than then when what which who whom whose where why how "
    "their there here just also some more most such only very been being did does doing done made "
    "make makes like said says want needs know really much many thing things stuff because since "
    "well even still both each"
).split()

# Characters NFKC never changes on their own and that never combine with a neighbour.
_STABLE = r"^[\x00-\x7E¡-§©«¬®°±¶·»¿-ıА-я–—‘-„€、。一-龥]*$"


@F.pandas_udf(T.StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """NFKC form. Only texts with characters that can change cross into Python."""
    stable = text.rlike(_STABLE)
    return F.when(stable, text).otherwise(_nfkc_batch(F.when(~stable, text)))


def _accent_table() -> tuple[str, str]:
    """Precomposed letters and their base letter, derived from the Unicode database."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _accent_table()


def fold_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _BASE)


BLANKS = " \t\n\r\f\v\u00a0\u3000\ufeff"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def match_form(text: Column, unicode: bool = True) -> Column:
    """Form used for comparisons: NFKC, trimmed, lower case."""
    return F.lower(strip(nfkc(text) if unicode else text))


def statement_form(text: Column, unicode: bool = True) -> Column:
    """Duplicate-detection form: punctuation and symbols become single spaces."""
    bare = F.regexp_replace(match_form(text, unicode), r"[\p{P}\p{S}]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def identity_form(text: Column, unicode: bool = True) -> Column:
    """Node identity: no punctuation, symbols or spaces at all."""
    base = F.lower(nfkc(text) if unicode else text)
    return F.regexp_replace(base, r"[\p{P}\p{S}\s]+", "")


def words_only(text: Column) -> Column:
    """Letters and digits separated by single spaces (the evaluation comparison form)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _pairs(token: Column) -> Column:
    """Adjacent character pairs of a token."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))),
        lambda i: F.substr(token, i, F.lit(2)),
    )


def search_terms(normal: Column) -> Column:
    """Distinct search terms of a normalised query; long Han runs add character pairs."""
    tokens = matches(normal, r"[\p{L}\p{N}_+.#-]+")
    words = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(SEARCH_STOP_WORDS))
    han = F.filter(tokens, lambda t: t.rlike(r"\p{IsHan}") & (F.length(t) > 4))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(han, _pairs))))


def may_hold_han(text: Column) -> Column:
    """Whether a character lies in or above the first block with Han script: a quicker test than the script itself."""
    return text.rlike(r"[^\x{0}-\x{2E7F}]")


def index_terms(text: Column) -> Column:
    """Index tokens with repeats: accent-folded lower-case letter/digit runs, Han pairs added."""
    low = F.lower(text)
    folded = F.when(F.octet_length(text) == F.length(text), low).otherwise(fold_accents(low))
    tokens = matches(folded, r"[\p{L}\p{N}]+")
    found = F.when(~may_hold_han(text), F.array().cast("array<string>")).otherwise(matches(folded, r"\p{IsHan}+"))
    runs = F.filter(found, lambda t: F.length(t) >= 2)
    return F.concat(tokens, F.array_distinct(F.flatten(F.transform(runs, _pairs))))


def query_index_terms(normal: Column) -> Column:
    """Search terms of a query cut into index tokens."""
    parts = F.transform(
        search_terms(normal), lambda t: matches(fold_accents(t), r"[\p{L}\p{N}]+")
    )
    return F.array_distinct(F.flatten(parts))


def content_tokens(text: Column) -> Column:
    """Distinctive tokens: numbers, words of four or more letters, Han pairs."""
    segments = matches(F.lower(text), r"\p{IsHan}+|[\p{L}\p{N}]+")
    han = F.filter(segments, lambda t: t.rlike(r"^\p{IsHan}+$") & (F.length(t) >= 2))
    latin = F.filter(
        segments,
        lambda t: ~t.rlike(r"^\p{IsHan}+$")
        & (t.rlike(r"\p{N}") | ((F.length(t) >= 4) & ~t.isin(FEEDBACK_STOP_WORDS))),
    )
    return F.array_distinct(F.concat(latin, F.flatten(F.transform(han, _pairs))))


def identity_tokens(normal: Column) -> Column:
    parts = F.split(normal, r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & (t != "time")))


def overlap_terms(normal: Column) -> Column:
    """Space-separated words of three or more; Han pairs for an unspaced Han query."""
    spaced = F.filter(F.split(normal, " "), lambda t: F.length(t) >= 3)
    return (
        F.when(normal.contains(" "), spaced)
        .when(normal.rlike(r"[一-鿿]"), F.when(F.length(normal) >= 2, _pairs(normal)).otherwise(F.array().cast("array<string>")))
        .otherwise(F.array(normal))
    )


def overlap_score(terms: Column, normal_statement: Column) -> Column:
    """Total length of the terms that occur in the statement."""
    hits = F.filter(terms, lambda t: (t != "") & normal_statement.contains(t))
    return F.aggregate(hits, F.lit(0), lambda s, t: s + F.length(t))


def lexical_score(normal_query: Column, normal_text: Column, terms: Column, hits: Column | None = None) -> Column:
    """Whole-query containment scores 10 + its length; otherwise the matched term lengths (``hits``: the matched terms, if known)."""
    hits = F.filter(terms, lambda t: normal_text.contains(t)) if hits is None else hits
    partial = F.aggregate(hits, F.lit(0), lambda s, t: s + F.length(t))
    return F.when(normal_text.contains(normal_query), F.length(normal_query) + 10).otherwise(partial)


def char_ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order, with repeats; empty when the text is shorter than n."""
    empty = F.array().cast("array<string>")
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
        lambda i: F.substr(text, i, F.lit(n)),
    )
    return F.when(F.length(text) >= n, grams).otherwise(empty)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct elements."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


# Literal-lookup rules for text that embeddings blur.
_CODE_LIKE = r"[\\/:._+#@-]"
_ERROR_CODE = r"^[A-Z][A-Z0-9_]{2,}$"
_CAMEL_CASE = r"^\p{Lu}[\p{L}\p{N}]*\p{Ll}[\p{L}\p{N}]*\p{Lu}[\p{L}\p{N}]*$"
# A token with a sign of code, a number or two capitals; tried at the start of a token only, so long runs stay linear.
_MAY_BE_CODED = r"(?<!\S)\S*?(?:[\\/:._+#@\-\p{N}]|\p{Lu}\S*?\p{Lu})\S*"
_EDGE = r"^[,;!?()\[\]{}]+|[,;!?()\[\]{}]+$"
_EDGE_QUOTED = r"^[,;!?()\[\]{}\"“”'‘’`]+|[,;!?()\[\]{}\"“”'‘’`]+$"


def surface_anchors(text: Column, unicode: bool = True) -> Column:
    """Quoted phrases, paths, versions, error codes and camel-case identifiers, normalised."""
    base = nfkc(text) if unicode else text
    ticked = F.regexp_extract_all(base, F.lit(r"`([^`\r\n]+)`"), F.lit(1))
    quoted = F.regexp_extract_all(base, F.lit(r"[\"“”'‘’]([^\"“”'‘’\r\n]+)[\"“”'‘’]"), F.lit(1))
    # Few tokens hold what any of the rules asks for; only those become elements.
    tokens = F.transform(F.regexp_extract_all(base, F.lit(_MAY_BE_CODED), F.lit(0)), lambda t: F.regexp_replace(t, _EDGE_QUOTED, ""))
    coded = F.filter(
        tokens,
        lambda t: t.rlike(_CODE_LIKE) | t.rlike(r"\p{N}") | t.rlike(_ERROR_CODE) | t.rlike(_CAMEL_CASE),
    )
    trimmed = F.transform(
        F.concat(ticked, quoted, coded),
        lambda t: F.trim(F.regexp_replace(F.trim(t), _EDGE, "")),
    )
    kept = F.filter(trimmed, lambda t: F.length(t) >= 3)
    return F.array_distinct(F.transform(kept, lambda t: F.lower(F.trim(t))))


def stable_id(*parts: Column) -> Column:
    """Deterministic id: SHA-256 of the JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
