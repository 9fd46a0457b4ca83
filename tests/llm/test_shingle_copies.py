"""Near-copies of the pipeline against all pairs compared by brute force."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import near_copies as nc, shingle_copies as sc

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(3000)]


def edited(text, k):
    words = text.split()
    for at in RNG.sample(range(len(words)), k):
        words[at] = RNG.choice(WORDS)
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, _low string").repartition(4)


def test_near_copies_stage_equals_brute_force(spark):
    base = [" ".join(RNG.choices(WORDS, k=n)) for n in (60, 100, 160, 240)]
    texts = [edited(base[i % 4], i % 5) for i in range(120)]  # some pairs over, some under the threshold
    chain = base[0]
    for _ in range(6):  # ends of the chain are less similar than its links
        chain = chain.split(" ", 5)[5] + " " + " ".join(RNG.choices(WORDS, k=5))
        texts.append(chain)
    texts += [" ".join(RNG.choices(WORDS, k=80)) for _ in range(20)] + ["Two Words", "two  words", "one", "", " \n", None]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert out.columns == ["doc_id", "text", "_low"]
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == brute.distinct_ids(rows)


def test_near_copies_stage_with_null_ids(spark):
    text = " ".join(WORDS[:50])
    out = sc.similar_representatives(frame(spark, [(None, text), (None, text), (3, text), (3, text), (None, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == [(False, 3), (True, 0)]
    assert sc.similar_representatives(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall_on_raw_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == brute.distinct_ids(rows)


def form_letters(n, common, own):
    return [" ".join([*WORDS[:common], *(f"own{i}x{k}" for k in range(own))]) for i in range(n)]


@pytest.mark.parametrize(("n", "common", "own"), [(400, 200, 60), (400, 200, 26)])
def test_form_letters_do_not_all_meet(spark, n, common, own):
    """Letters of one form, Jaccard 0.61 and 0.77, none a copy of another: candidates are fewer than letters."""
    rows = [(i, t) for i, t in enumerate(form_letters(n, common, own))]
    lettered = frame(spark, rows).select("doc_id", sc.text_key(F.col("text")).alias("key"), F.col("text").alias("_text"))
    sets = sc.stored(sc._described(lettered.select("key", "_text"), lambda x: x.view(np.int64)))
    assert sc.prefix_pairs(sets, sets.select("key", F.col("key").alias("label"))).count() < n
    assert sc.similar_representatives(frame(spark, rows)).count() == n


def test_prefix_join_leaves_no_similar_pair_out(spark):
    texts = [edited(" ".join(WORDS[:k]), j) for k in (40, 90, 100, 115) for j in range(12)] + form_letters(20, 200, 20)
    rows = list(enumerate(texts))
    keyed = spark.createDataFrame(rows, "key bigint, _text string")
    sets = sc.stored(sc._described(keyed, lambda x: x.view(np.int64)))
    found = {(r["a"], r["b"]) for r in sc._confirmed(sc.prefix_pairs(sets, keyed.select("key", F.col("key").alias("label"))), sets, 0.8).collect()}
    want = set(brute.jaccard_links(brute.shingle_sets(texts)))
    assert found == want and len(want) > 50


def test_the_trie_join_of_fingerprints_links_first(spark, monkeypatch):
    """The stage's copies come through op10's join; its fingerprints are those of five-word shingles."""
    text = " ".join(RNG.choices(WORDS, k=600))
    rows = [(1, text), (2, text + " more"), (3, " ".join(RNG.choices(WORDS, k=600))), (4, ""), (5, "one two")]
    assert all(sc.fingerprint(sc.hashes(x)) == nc.fingerprint(x, 5) for x in (t.encode() for _, t in rows))
    seen, join = [], sc.trie_join
    monkeypatch.setattr(sc, "trie_join", lambda prints: seen.append(join(prints)) or seen[-1])
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5}
    assert len(seen) == 1 and seen[0].count() == 1
