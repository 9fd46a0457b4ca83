"""Recall-need vocabulary compiled to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from keelson.functions import text as tx

EDGE = r"[\p{IsLatin}\p{N}_]"


@dataclass(frozen=True)
class Term:
    phrase: str
    mode: str
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    gap: int = 4096
    start: bool = False
    sentence: bool = False
    named: bool = False
    prefix: bool = False


def terms(phrases: str | list[str], mode: str = "retrieve", **conditions) -> list[Term]:
    listed = phrases if isinstance(phrases, list) else phrases.split()
    return [Term(p, mode, **conditions) for p in listed]


# The recall vocabulary, in match order.
VOCABULARY: tuple[Term, ...] = tuple(
    terms("之前 先前 以前 上次 曾经 当时 还记得 回忆 记忆中")
    + terms("你记得 您记得", after=("吗", "什么", "哪", "谁", "多少", "几", "？", "?"), sentence=True)
    + terms("来着", after=("？", "?"), gap=0)
    + terms("用过 说过 提过 决定过 选择过 讨论过 告诉过", before=("我", "我们"), gap=16)
    + terms(
        "现在 当前 最近 最新", before=("我", "我们"), gap=12,
        after=("什么", "哪个", "多少", "是谁", "用", "使用", "喜欢", "偏好", "决定", "选择"),
    )
    + terms("偏好 习惯 要求 历史", before=("根据我的", "按照我的"), gap=0)
    + terms(["remember", "previously", "before", "last time", "earlier", "used to", "did i", "did we", "have i", "have we"])
    + terms(["what", "how many", "how long"], after=("i", "we"), gap=32)
    + terms(["what", "when", "where", "who", "which", "how many", "how long"], start=True, after=("my",), gap=32)
    + terms(["my current", "my latest", "my previous", "my last", "my preference", "my preferences", "my history"])
    + terms(["what did", "when did", "where did", "which did", "how did"], named=True)
    + terms([
        "letztes mal", "früher", "erinnerst du", "dernière fois", "auparavant", "souviens-toi", "前回", "覚えて",
        "última vez", "anteriormente", "recuerdas",
    ])
    + terms("meine", after=("bevorzugte", "präferenz"), gap=24)
    + terms("ma mon mes", after=("préfér",), prefix=True, gap=24)
    + terms("私", after=("好む", "好み", "好き", "選ん", "決め"), gap=20)
    + terms("mi", after=("preferida", "preferido", "preferencia"), gap=24)
    + terms([
        "推荐", "建议", "方案", "规划", "计划", "怎么做", "如何选择", "帮我选", "recommend", "recommendation", "suggest",
        "suggestion", "advice", "plan", "planning", "which should i", "which should we", "what should i", "what should we",
        "how should i", "how should we",
    ], mode="cue")
)


def _bounded(word: str, prefix: bool = False) -> tuple[str, str, str]:
    """Escaped word with its left and right edge conditions."""
    left = f"(?<!{EDGE})" if re.match(r"[^\W]", word[0]) and not _han(word[0]) else ""
    right = f"(?!{EDGE})" if re.match(r"[^\W]", word[-1]) and not _han(word[-1]) and not prefix else ""
    return left, re.escape(word), right


def _han(char: str) -> bool:
    """Scripts other than Latin carry no word edge."""
    return ord(char) >= 0x0370


def _gap(limit: int, sentence: bool) -> str:
    """Between 1 and ``limit`` trimmed characters, optionally inside one sentence."""
    stops = "。！？?\\n" if sentence else ""
    anything, solid = (rf"[^{stops}]", rf"[^\s{stops}]") if sentence else (r"[\s\S]", r"\S")
    if limit == 0:
        return r"\s+"
    return rf"(?:\s*{solid}(?:{anything}{{0,{max(0, limit - 2)}}}{solid})?\s*|\s+)"


def pattern(term: Term) -> str:
    """Regular expression equal to the term's phrase plus its context conditions."""
    left, phrase, right = _bounded(term.phrase)
    before = after = ""
    gap = _gap(term.gap, term.sentence)
    if term.before:
        options = []
        for word in term.before:
            l, w, r = _bounded(word)
            options.append(f"{l}{w}(?:{r}{gap})?")
        before = "(?:" + "|".join(options) + ")"
    if term.after:
        options = []
        for word in term.after:
            l, w, r = _bounded(word, term.prefix)
            options.append(f"(?:{gap}{l})?{w}{r}")
        after = "(?:" + "|".join(options) + ")"
    if term.named:
        after = r"\s+\p{L}"
    start = "^" if term.start else ""
    return f"{start}{before}{left}{phrase}{right}{after}"


def recall_mode(prompt: Column, vocabulary: tuple[Term, ...] = VOCABULARY) -> Column:
    """``retrieve``, ``cue`` or ``none`` for a normalised prompt.

    One alternation over the bare phrases screens rows first, so the conditional patterns only
    run on prompts that contain some phrase at all.
    """
    retrieve = [pattern(t) for t in vocabulary if t.mode == "retrieve"]
    cue = [pattern(t) for t in vocabulary if t.mode == "cue"]
    screen = "|".join(sorted({re.escape(t.phrase) for t in vocabulary}, key=len, reverse=True))

    def hit(patterns: list[str]) -> Column:
        return prompt.rlike("|".join(f"(?:{p})" for p in patterns))

    return F.when(~prompt.rlike(screen), "none").when(hit(retrieve), "retrieve").when(hit(cue), "cue").otherwise("none")


def first_terms(prompt: Column, vocabulary: tuple[Term, ...] = VOCABULARY) -> Column:
    """All matched phrases, in vocabulary order (input of the per-session phrase pool)."""
    return F.array_compact(F.array(*[F.when(prompt.rlike(pattern(t)), F.lit(t.phrase)) for t in vocabulary]))


# Prompts that are about text itself, and prompts that refuse memory.
LITERAL_TASK = r"(?i)(?:翻译|字符串|打印|translate|literal string|print)"
MEMORY_REFUSED = r"(?i)(?:不要|不用|不需要|别).{0,8}(?:记忆|回忆|检索)|\b(?:without|no|don't use|do not use)\s+memory\b"
# Quoted code and quoted words, which are not the user's own question.
CODE_BLOCK = r"```[\s\S]*?(?:```|$)"
QUOTED = "`[^`\\n]*(?:`|$)|“[^”]*”|「[^」]*」|\"[^\"\\n]*\"|'[^'\\n]*'"


def recall_input(prompt: Column) -> Column:
    """Prompt text the gate looks at; empty when recall is out of place or the prompt holds a secret."""
    from keelson.operators.curation import SECRET_PATTERNS, any_match

    base = tx.nfkc(prompt)
    blocked = (F.length(base) > 4096) | any_match(base, SECRET_PATTERNS) | base.rlike(LITERAL_TASK) | base.rlike(MEMORY_REFUSED)
    bare = F.regexp_replace(F.regexp_replace(base, CODE_BLOCK, " "), QUOTED, " ")
    return F.when(blocked, "").otherwise(F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))))
