"""Quality rules, word pieces, byte-level BPE, contamination, licenses and URL rules on small rows."""

from __future__ import annotations

import hashlib
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import bpe, contamination as con, licenses, quality, url_rules, wordpiece

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t ", "one", "a b", "the cat sat on the mat and the cat sat on the mat " * 8, "ÀÉ ß ñandú 中文 text\n\nline\nline\n", LONG,
    "# $ % & | <>\n# $ % & | <>\nThe end.", "the cat sat on the mat and the cat sat on the mat " * 8, "x\x0by\x0cz\r\nw",
]
SCHEMA = "doc_id bigint, text string, n_words string, ids string, score string, _text string, _words int, h string, items string, hit_spans string"


@pytest.fixture(scope="module")
def rows():
    ids = [None, 1, 2, 2, 4, 5, 6, 7, 8, 5, 10]
    return [(i, t, "n", "i", "s", "t", 1, "h", "x", "y") for i, t in zip(ids, TEXTS, strict=True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_text(df, *columns):
    return {(r["doc_id"], r["text"]): tuple(r[x] for x in columns) for r in df.collect()}


def test_quality_counts(docs, rows):
    got = by_text(quality.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc_id, text, *_ in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = brute.repeated_words(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words))
        assert got[doc_id, text] == want


def test_quality_random_repeats(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_metrics(df).collect()}
    assert got == {i: brute.repeated_words(t.split()) for i, t in enumerate(texts)}


def test_quality_is_native(docs):
    assert "Python" not in quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()


def test_wordpiece_counts(spark, docs, rows):
    ranks, _ = bpe.public_vocabulary()
    longest = max(map(len, ranks))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in ranks), at + 1)
            n += 1
        return n

    got = by_text(wordpiece.token_counts(docs, ranks), "n_words", "n_tokens")
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        assert got[doc_id, text] == (len(words), sum(greedy(b" " + w) for w in words))


@pytest.mark.parametrize("pieces", [{b"a", b"abc", b"abcd", b"bcx", b"cd", b"dde"}, {b"ab", b"abab", b"babx", b"ba"}, set()])
def test_automaton_without_full_cover(pieces):
    automaton, rng = wordpiece.build_automaton(pieces), random.Random(2)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcdex") for _ in range(rng.randint(0, 14)))
        n = at = 0
        while at < len(word):
            at = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), at + 1)
            n += 1
        assert automaton.count(word) == n


def test_replay_equals_library():
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    library, rng = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), random.Random(1)
    words = [bytes(rng.choice(b"aaabcdeh \xc3\xa9\xff!0") for _ in range(rng.randint(1, 30))) for _ in range(4000)] + [b"", b"a" * 700]
    got = bpe.replay(words, [ranks[bytes([b])] for b in range(256)], bpe.merge_table(ranks))
    want = [library._encode_single_piece(w) if w else [] for w in words]
    assert got == want
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.replay_many(words, bpe.Merges(ranks))] == want


def test_replay_with_lower_rank_made_later():
    """A merge makes a pair of lower rank while other places of the same word still wait."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 5, b"abc": 3, b"cab": 2, b"bc": 9}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    words = [w for w in words if w not in ranks]
    single, merges = [ranks[bytes([b])] for b in range(256)], bpe.merge_table(ranks)
    want = [library._encode_single_piece(w) for w in words]
    assert bpe.replay(words, single, merges) == want
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.replay_many(words, bpe.Merges(ranks))] == want


def test_bpe_round_trip(docs, rows):
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_text(bpe.bpe_round_trip(docs, ranks, pattern), "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    apart = by_text(bpe.bpe_decode(bpe.bpe_encode(docs, ranks, pattern), ranks), "ids", "decoded")
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id, text] == (ids, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())
        assert apart[doc_id, text] == (ids, (text or "").encode())


ITEMS = [(1, "The cat sat on the mat and the cat sat on the mat."), (2, "a B"), (3, None), (4, "..."), (None, "w1 w2"), (5, " ".join(f"w{i}" for i in range(100, 130))), (5, "ONE"), (6, "a b")]


@pytest.mark.parametrize("block_chars", [32_000_000, 40])
def test_contamination(spark, docs, rows, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = con.contamination(docs, items, block_chars=block_chars)
    spans, names = [x for x in found.columns if x.endswith("hit_spans")][-1], [x for x in found.columns if x.endswith("items")][-1]
    got = {(r["doc_id"], r["text"]): (r["n_words"], r["hit"], r[names], r["contaminated"]) for r in found.withColumn("hit", con.hit_words(spans)).collect()}
    for doc_id, text, *_ in rows:
        n, hit, ids = brute.contaminated(text, ITEMS)
        assert got[doc_id, text] == (n, hit, ids, hit > 0)


def test_contamination_random(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(6)] + [(9, " ".join(word() for _ in range(14)))]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [f"x {items[-1][1]} y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = con.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).withColumn("hit", con.hit_words())
    for r in found.collect():
        assert (r["n_words"], r["hit"], r["items"]) == brute.contaminated(texts[r["doc_id"]], items)


def test_licenses(spark):
    mit = dict(reversed(licenses.TEMPLATES[2:4]))["mit"]
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.", 2: "Licensed under CC BY 4.0.", 3: "Licensed under CC BY-NC 4.0.", 4: None, 5: "",
        6: "He had permission to license the copyright of a long and winding story about nothing at all.", 7: "/* " + mit.replace(", ", ",\n * ") + " */",
        8: ("word " * 3000) + "This work is licensed under the GNU General Public License, version 3. " + "word " * 3000,
        9: "All rights reserved.\n\n\n\n\n\nLicensed under the Apache License, Version 2.0.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, n_candidates string")
    got = {r["doc_id"]: sorted({s["license"] for s in r["license_spans"]}) for r in licenses.license_scan(df).collect()}
    assert got == {1: ["mit"], 2: ["cc-by-4.0"], 3: ["cc-by-nc-4.0"], 4: [], 5: [], 6: [], 7: ["mit"], 8: ["gpl-3.0"], 9: ["all-rights-reserved", "apache-2.0"]}


def test_license_differences():
    t = licenses.words_of("Licensed under CC BY 4.0.")
    assert licenses.differences(t, t) == 0
    assert licenses.differences(licenses.words_of("Licensed under CC BY-NC 4.0."), t) == 2
    assert licenses.differences([], t) == len(t)


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "", "block"),
    ("example.net", "/en/x/", "block"), ("EXAMPLE.net", "/en/x/y", "allow"), (None, "/", "block"), ("", "/", "block"), ("b.org", "/é", "block"), ("net", "/", "allow"), ("xample.com", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://example.net", "http://example.net/", "https://blog.Example.NET/en/1?x#y", "http://example.net/en/x/1", "http://example.net/en/x/yz", "http://net/", "http://anet/",
    "http://example.com/de/1", "http://notexample.com/de/1", "http://a.b.org/é", "http://x.a.b.org", "http://b.org/é/1", "x://c.org/fr/?q", "http://example.org/fr", "http://a://b.net/", "http://-net.net/en/", "http://...", "http://net./",
]


def fit(url):
    host = path = ""
    if url and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    table = {}
    for h, p, v in RULES:
        if h:
            key = h.lower(), p or ""
            table[key] = max(v, table.get(key, ""))
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in table.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i % 19, u, "r", "k") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, rule string, _key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_rules.match_rules(pages, rules).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == fit(r["url"]), r["url"]


def test_url_rules_are_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert "Python" not in url_rules.match_rules(pages, url_rules.rule_table(spark))._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    ranks, pattern = bpe.public_vocabulary()
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert quality.quality_rules(docs).count() == 0
    assert wordpiece.token_counts(docs, ranks).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(docs, ranks, pattern), ranks).count() == 0
    assert con.contamination(docs, nothing).count() == 0
    assert not con.contamination(some, nothing).first()["contaminated"]
    assert licenses.license_scan(docs).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_rules.match_rules(pages.where("false"), url_rules.rule_table(spark)).count() == 0
    assert url_rules.match_rules(pages, none).first()["verdict"] == "allow"


def test_null_ids_decode_to_nothing(spark):
    ranks, _ = bpe.public_vocabulary()
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.bpe_decode(df, ranks).collect()] == [b"", b""]


def test_long_texts_are_whole(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id bigint, text string")
    assert quality.quality_metrics(df).first()["n_words"] == 60_000
    assert df.select(F.length("text")).first()[0] == len(LONG)
