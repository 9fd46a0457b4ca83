"""Toxicity, language-model scores, line chunks, near-copies and the pipeline on small rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from keelson.llm import interpolation as lm, line_chunks as lc, near_copies as nc, toxicity as tox

RNG = random.Random(11)
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("n", "rt", "sel", "mo", "x")]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


# toxicity

def toxic_rows(n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(40).split()
        if bad:
            words[RNG.randrange(40)] = words[RNG.randrange(40)] = RNG.choice(["grunk", "blorf"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = toxic_rows()
    odd = [(None, "grunk blorf grunk"), (7001, None), (7002, ""), (7003, prose(50_000)), (3, rows[3][1])]
    docs = frame(spark, [(*r, 1.0, False) for r in rows + odd], ", score double, held_out boolean")
    judged = spark.createDataFrame(labels + [(10, 0, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    out = tox.toxicity(docs, judged).toPandas()
    assert len(out) == len(rows) + len(odd)
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    held = out[out["doc_id"].notna()].apply(lambda r: r["held_out"] == (zlib.crc32(str(int(r["doc_id"])).encode()) % 5 == 0), axis=1)
    assert held.all() and not out[out["doc_id"].isna()]["held_out"].any()
    truth = {i: t for i, _, t in labels}
    test = out[out["held_out"] & (out["doc_id"] < 7000)]
    assert (test["predicted"] == test["doc_id"].map(truth)).mean() > 0.97
    assert out[out["doc_id"].isna()]["predicted"].iloc[0] == 1
    again = tox.toxicity(docs.repartition(5), judged).toPandas()
    key = ["doc_id", "text"]
    assert np.allclose(out.sort_values(key)["score"], again.sort_values(key)["score"])


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["predicted"] for r in tox.toxicity(docs, none).collect()] == [0, 0]
    assert tox.toxicity(docs.where("false"), none).count() == 0


def test_toxicity_sample_is_bounded(spark):
    rows, labels = toxic_rows(50)
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert tox.sample(frame(spark, rows * 2), given, ~tox.held_out(), rows=20).count() == 20


def test_weights_are_sparse():
    p = tox.Ftrl(bits=10)
    z, n = np.zeros(1025), np.zeros(1025)
    rows = [np.unique(np.random.default_rng(i).integers(0, 1024, 30)) for i in range(200)]
    tox.train(rows, np.array([int(5 in r) for r in rows], float), z, n, p)
    w = tox.weights_of(z, n, p)
    assert w[5] > 0 and (w != 0).sum() < 1000


# language model

def lm_brute(rows, held=2, deleted=3):
    tokens = [brute.SPACE_WORDS.findall((t or "").encode().lower()) + [b""] for _, t in rows]
    fold = [-1 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in rows]

    def count(kept):
        uni, bi = Counter(), Counter()
        for x, f in zip(tokens, fold, strict=True):
            if kept(f):
                uni.update(x)
                bi.update(zip([b"", *x], x, strict=False))
        return uni, bi

    uni, bi = count(lambda f: f >= 0 and f != held)
    less, less_bi = count(lambda f: f >= 0 and f not in (held, deleted))
    total, distinct = sum(uni.values()), len(uni)
    cells = Counter()
    for x, f in zip(tokens, fold, strict=True):
        if f == deleted:
            for a, b in zip([b"", *x], x, strict=False):
                est = (less_bi[a, b] / less[a] if less[a] else 0, less[b] / sum(less.values()) if less else 0)
                cells[int(lm.context_bucket(np.array([less[a]]))[0]), *(round(lm.STEPS * math.log2(p)) if p else 1 for p in est)] += 1
    frame = pd.DataFrame([(*k, n) for k, n in cells.items()], columns=["bucket", "bigram", "unigram", "n"])
    weights = lm.mixture_weights(frame, 1 / (distinct + 1))
    out = []
    for x in tokens:
        model = 0.0
        for a, b in zip([b"", *x], x, strict=False):
            w = weights[lm.context_bucket(np.array([uni[a]]))[0]]
            model += math.log10(w[0] * (bi[a, b] / uni[a] if uni[a] else 0) + w[1] * (uni[b] / total if total else 0) + w[2] / (distinct + 1))
        out.append((len(x), sum(uni[w] > 0 for w in x), total, sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in x), model))
    return out


@pytest.mark.parametrize(("block", "shard"), [(1_000_000, 256_000), (50, 40)])
def test_language_scores(spark, block, shard):
    rows = [(i, prose(RNG.randint(0, 60)).upper() if i % 9 == 0 else prose(RNG.randint(0, 60))) for i in range(80)]
    rows += [(None, prose(30)), (100, None), (101, ""), (5, rows[5][1]), (102, "unseen É Ñ\x0b words"), (103, prose(20_000))]
    docs = frame(spark, [(*r, "s", 1) for r in rows], ", score string, block int").repartition(4)
    got = lm.language_scores(docs, lm.crc_fold(), 2, 3, block_tokens=block, shard_tokens=shard).toPandas()
    key = lambda r: (r[0] is None or r[0] != r[0], r[0] or 0, r[1], r[4])
    want = sorted(((i, *x) for (i, _), x in zip(rows, lm_brute(rows), strict=True)), key=key)
    have = sorted(((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.itertuples()), key=key)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in have], [x[4:] for x in want], rtol=1e-9)


def test_language_scores_with_nothing_to_learn(spark):
    assert lm.language_scores(frame(spark, []), lm.crc_fold(), 2, 3).count() == 0
    alone = lm.language_scores(frame(spark, [(None, "a b"), (None, None)]), lm.crc_fold(), 2, 3).toPandas()
    assert alone["train_tokens"].eq(0).all() and np.allclose(alone["score"], alone["n_tokens"] * math.log10(1 / 3))


def test_mixture_weights_prefer_the_better_estimate():
    cells = pd.DataFrame([(3, -4, -40, 900), (3, 1, -20, 100), (9, 1, -8, 500)], columns=["bucket", "bigram", "unigram", "n"])
    w = lm.mixture_weights(cells, 1e-4)
    assert w[3][0] > 0.85 and w[9][1] > 0.99 and np.allclose(w.sum(axis=1), 1)


# line chunks

def test_line_dedup(spark):
    passage = "\n".join(prose(25) for _ in range(3))
    short = "\n".join(prose(6) for _ in range(12))
    single = prose(60)
    rows = [(i, "\n".join([prose(30), *([passage] if i % 3 == 0 else []), prose(8), prose(12), *([short] if i % 4 == 0 else []), *([single] if i % 5 == 0 else []), prose(40)])) for i in range(40)]
    boiler = "all rights are kept by us"
    rows += [(50 + i, "\n".join([prose(30), boiler, prose(30)])) for i in range(5)]
    rows += [(None, rows[0][1]), (70, None), (71, ""), (72, ""), (3, rows[3][1]), (73, rows[1][1]), (74, "\n".join([prose(22)] * 2000)), (75, "\n\n\n")]
    docs = frame(spark, [(*r, 1, "t", 2) for r in rows], ", n_lines int, _th string, _gone int").repartition(3)
    out = lc.line_dedup(docs)
    assert set(docs.columns) <= set(out.columns)
    want = brute.line_dedup(rows, lc.ROLL, lc.DIVISOR, lc.LONG_WORDS, lc.RUN_WORDS, lc.CHUNK_WORDS, lc.SEED_WORDS, lc.SHIFT_WORDS)
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=order) == sorted(((i, w) for (i, _), w in zip(rows, want, strict=True)), key=order)
    texts = [r["text"] or "" for r in out.collect()]
    assert sum(passage in x for x in texts) <= 1 and sum(single in x for x in texts) <= 1
    assert sum(boiler in x for x in texts) == 5


@pytest.mark.parametrize(("lines", "words"), [(3, 18), (4, 14), (5, 11), (6, 10), (12, 6), (14, 4), (30, 2)])
def test_passages_of_short_lines_go(spark, lines, words):
    """A passage of over 50 words between other short lines stays in the first document only, to the last line."""
    rows, passages = [], []
    for i in range(60):
        passages.append("\n".join(f"p{lines}x{i}x{k} " + prose(words - 1) for k in range(lines)))
        rows += [(3 * i + d, "\n".join([*(prose(RNG.randrange(1, 9)) for _ in range(3)), passages[-1], *(prose(RNG.randrange(1, 9)) for _ in range(3))])) for d in range(3)]
    left = {r["doc_id"]: r["text"] for r in lc.line_dedup(frame(spark, rows)).collect()}
    for i, passage in enumerate(passages):
        assert passage in left[3 * i]
        for d in (1, 2):
            assert not set(passage.split("\n")) & set(left[3 * i + d].split("\n"))
        # lines around it stay, unless they repeat by chance
        assert all(len(left[3 * i + d].split("\n")) >= 4 for d in (1, 2))


def test_line_dedup_of_nothing(spark):
    assert lc.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_is_native(spark):
    plan = lc.line_dedup(frame(spark, [(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# near-copies

def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    values = [base]
    for flips in (1, 2, 3, 4, 2):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        values.append(x)
    values = np.unique(np.concatenate(values + [np.arange(70, dtype=np.uint64)]))
    for budget in (0, 1, 3):
        forest = nc.Forest(len(values))
        nc.trie_links(values, values, True, 0, budget, forest)
        assert forest.parent.tolist() == brute.classes(values.tolist(), lambda a, b, k=budget: (a ^ b).bit_count() <= k)


def test_near_copies(spark):
    base = [prose(300) for _ in range(6)]
    rows = []
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(i % 4):
            words[RNG.randrange(300)] = RNG.choice(WORDS)
        rows.append((200 - i, " ".join(words)))
    rows += [(300 + i, prose(80)) for i in range(20)] + [(1, None), (2, ""), (3, " \n"), (None, ""), (None, prose(40)), (400, "Two Words"), (401, "two words"), (402, "one"), (200, rows[0][1]), (403, prose(70_000))]
    docs = frame(spark, [(*r, 5, "c", 1) for r in rows], ", simhash int, component string, _simhash int").repartition(4)
    prints = [brute.simhash(t) for _, t in rows]
    classes = brute.classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for (i, _), c in zip(rows, classes, strict=True):
        if i is not None:
            lowest[c] = min(i, lowest.get(c, i))
    want = Counter((i, f"{p:016x}", lowest.get(c)) for (i, _), p, c in zip(rows, prints, classes, strict=True))
    out = nc.near_copies(docs)
    got = Counter((r["doc_id"], r["p"], r["component_id"]) for r in out.select("doc_id", nc.hex_print(out["simhash"]).alias("p"), "component_id").collect())
    assert got == want
    kept = nc.representatives(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted({(lowest.get(c) is None, lowest.get(c) or 0) for c in classes})
    assert nc.representatives(docs).columns == docs.columns


def test_near_copies_of_nothing(spark):
    assert nc.near_copies(frame(spark, [])).count() == 0
    assert nc.near_copies(frame(spark, [(4, "a b c d")])).first()["component_id"] == 4


# pipeline

@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = corpus_pipeline.stored(stage(spark, docs, sf))
        if name != "bpe":
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            gone = {i for i, _ in before} - set(after)
            assert len(gone - toxic) <= 0.2 * len(before) and set(after) <= {i for i, _ in before}
        elif name == "line_dedup":
            want = brute.line_dedup(before, lc.ROLL, lc.DIVISOR, lc.LONG_WORDS, lc.RUN_WORDS, lc.CHUNK_WORDS, lc.SEED_WORDS, lc.SHIFT_WORDS)
            assert after == dict(zip([i for i, _ in before], want, strict=True))
        elif name == "near_copies":
            assert set(after) == brute.distinct_ids(before)
        elif name == "decontamination":
            assert set(after) == {i for i, t in before if not brute.contaminated(t, items)[1]}
        else:
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
        docs = out


def test_pipeline_accepts_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, prose(100), None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "x y")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2]
