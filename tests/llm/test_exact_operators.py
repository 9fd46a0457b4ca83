"""Exact dedup, whitening and source divergence against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import divergence as dv, exact_copies as ec, whitening as wh

RNG = random.Random(5)


# exact dedup

def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[bare(text)].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for body, members in groups.items():
        best = min(members)
        for _, none, doc, i in members:
            out.append((None if none else doc, None if best[1] else best[2], len(members), i == best[3], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def copied_rows(n=400):
    bodies = ["", "a b", "ab", "café x", "\U0001f600 y z", "longer text " * 50, *[f"text {i}" for i in range(60)]]
    rows = []
    for i in range(n):
        body = bodies[0 if i % 3 == 0 else RNG.randrange(len(bodies))]  # a third of all rows are copies of one text
        rows.append((i, "".join(ch + RNG.choice(["", " ", "\n\t"]) if RNG.random() < 0.2 else ch for ch in body)))
    return rows + [(None, "a b"), (None, None), (7, None), (7, rows[7][1]), (7, rows[7][1]), (9001, "x" * 200_000)]


def found_copies(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in df.collect()), key=str)


@pytest.mark.parametrize("node_rows", [500_000, 1])
def test_exact_copies(spark, node_rows):
    rows = copied_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, sha string, row int").repartition(7)
    assert found_copies(ec.exact_copies(docs, node_rows=node_rows)) == brute_copies(rows)
    stay = ec.distinct_documents(docs)
    assert stay.columns == docs.columns
    assert sorted(bare(r["text"]) for r in stay.collect()) == sorted({bare(t) for _, t in rows})


def test_exact_copies_other_ids_and_empty(spark):
    docs = spark.createDataFrame([("b", "t x"), ("a", "t\nx"), (None, "tx "), ("c", "other")], "name string, body string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in ec.exact_copies(docs, "body", "name").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), None: ("a", False), "c": ("c", True)}
    assert ec.exact_copies(docs.where("false"), "body", "name").count() == 0
    assert ec.distinct_documents(docs.where("false"), "body", "name").count() == 0


def test_leading_bits_alone_do_not_make_copies():
    words = np.array([[5, 1, 0, 0], [5, 2, 0, 0], [5, 1, 0, 0], [5, 2, 0, 1]], np.uint64)
    run = ec.merge([ec.Run(words[i : i + 1], np.array([1]), np.array([i]), np.array([i]), pa.array([i])) for i in range(4)])
    assert sorted(zip(run.n.tolist(), run.id.to_pylist(), strict=True)) == [(1, 1), (1, 3), (2, 2)]


def test_rounds_grow_with_the_rows():
    assert ec.rounds_of(0) == 2 and ec.rounds_of(10**10) == 5


# whitening

def brute_whitening(x):
    x = [[int(v) for v in row] for row in x]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    m = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, m, [sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]


def test_polynomial_of_known_roots(spark):
    roots = [0, 0, 3, 3, 3, 10, 10**15, 10**15 + 1]
    draw = np.random.default_rng(1)
    # similar to the diagonal matrix by integer steps of determinant one
    m = np.diag(np.array(roots, object))
    for _ in range(40):
        i, j = draw.choice(len(roots), 2, replace=False)
        k = int(draw.integers(-3, 4))
        m[i] = m[i] + k * m[j]
        m[:, j] = m[:, j] - k * m[:, i]
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    used = wh.primes(20)
    got = wh.chinese_remainder(used, [wh.polynomial_modulo(m.tolist(), p) for p in used])
    assert got == poly
    assert [wh.roots_above(poly, a) for a in (-1, 0, 3, 9, 10**15, 10**15 + 1)] == [8, 6, 3, 3, 1, 0]
    low, k = wh.root_bracket(poly, 2, sum(roots))
    assert Fraction(low, 1 << k) < 10**15 <= Fraction(low + 1, 1 << k)
    assert wh.root_bracket(poly, 4, sum(roots)) == wh.root_bracket(poly, 5, sum(roots)) == wh.root_bracket(poly, 6, sum(roots))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, label string")


def check_whitening(out, x, places):
    n, _, m, deviation = brute_whitening(x)
    matrix = np.array([[float(v) for v in r] for r in m])
    values = np.linalg.eigvalsh(matrix)[::-1]
    frame = out.toPandas()
    parts = frame["component"].max()
    assert len(frame) == parts * len(x)
    assert (frame["n"] == n).all() and (frame["identity_error"] < 1e-9).all()
    for place, dev in zip(places, deviation, strict=True):
        assert int(frame[frame["place"] == place]["deviation"].iloc[0]) == dev
    for k in range(1, parts + 1):
        own = frame[frame["component"] == k].set_index("place")["whitened"]
        explained = frame[frame["component"] == k]["explained"].iloc[0]
        assert math.isclose(explained, values[k - 1] / np.trace(matrix), rel_tol=1e-9)
        w = own[places].to_numpy()
        centred = (np.array([[float(v) for v in r] for r in x]) - np.mean(np.array(x, float), axis=0))
        # the covariance of the whitened values with the entries is the eigenvector times the deviation along it
        axis = centred.T @ w / n
        assert np.allclose(matrix / n**2 @ axis, values[k - 1] / n**2 * axis, rtol=1e-6, atol=1e-6 * np.abs(axis).max() * values[0] / n**2)
    return parts


def test_whitening_against_numpy(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(0, 1, (150, 12)) @ draw.normal(0, 0.2, (12, 12))
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(base)]
    odd = [(900, None, 1, "a"), (901, [1.0] * 11 + [None], 1, "a"), (902, [float("nan")] * 12, 1, "a"), (903, [float("inf")] + [0.0] * 11, 1, "a"), (904, [], 1, "a"), (905, [1.0, 2.0], 1, "a"), (906, [1e300] * 12, 1, "a")]
    repeated = [(0, base[0].tolist(), 1, "a"), (None, base[1].tolist(), 1, "a")]
    df = vectors(spark, rows + odd + repeated).repartition(5)
    x = [np.floor(1024 * np.array(r[1])).astype(int) + wh.SHIFT for r in rows + repeated]
    renamed = df.withColumn("place", df["vec_id"])
    out = wh.whiten(renamed)
    assert out.columns == ["vec_id", "label", "place", "n", "deviation", "component", "whitened", "explained", "identity_error"]
    frame = out.toPandas()
    assert len(frame) == 8 * len(x) and frame["vec_id"].isna().sum() == 8
    keyed = vectors(spark, [(i, r[1], 1, "a") for i, r in enumerate(rows + repeated)]).withColumnRenamed("vec_id", "place")
    assert check_whitening(wh.whiten(keyed.select("place", "embedding")), x, list(range(len(x)))) == 8


def test_whitening_with_equal_and_missing_variances(spark):
    # the corners of a cross: one eigenvalue, as often as there are dimensions; the last dimension is constant
    rows = [(2 * i + s, [(1 - 2 * s) * float(j == i) for j in range(5)] + [3.0], 1, "a") for i in range(5) for s in range(2)]
    keyed = vectors(spark, rows).withColumnRenamed("vec_id", "place").select("place", "embedding")
    x = [np.floor(1024 * np.array(r[1])).astype(int) for r in rows]
    assert check_whitening(wh.whiten(keyed), x, [r[0] for r in rows]) == 5


def test_whitening_of_large_entries_is_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.integers(-(1 << 50), 1 << 50, 3)], 1, "a") for i in range(9)]
    n, s, m, _ = brute_whitening([[int(math.floor(1024 * v)) for v in r[1]] for r in rows])
    got = wh.scatter(vectors(spark, rows).repartition(3), "embedding")
    assert got == (n, s, m)
    assert wh.whiten(vectors(spark, rows)).toPandas()["identity_error"].max() < 1e-6


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, "a")], [(i, [1.0, 2.0], 1, "a") for i in range(4)], [(1, None, 1, "a")]):
        out = wh.whiten(vectors(spark, rows))
        assert out.count() == 0 and "whitened" in out.columns


# source divergence

WORDS = ["Alpha", "beta", "GAMMA", "délta", "中文", "x1y", "it's", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]]


def brute_divergence(rows, least, ranks):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = find((text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: shares(groups[lang, s]) for s in sources}
        every = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[s][t] - every[t], t) for t in kept if groups[lang, s][t] and own[s][t] > every[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def spoken_rows(n=300):
    rows = []
    for i in range(n):
        lang = "en" if i % 3 == 0 else RNG.choice(["de", None, "fr"])
        source = "hot" if i % 3 == 1 else RNG.choice(["s1", "s2", None, "ü"])
        rows.append((RNG.choice([" ", "-", "\n"]).join(RNG.choices(WORDS, k=RNG.randrange(0, 30))), lang, source))
    return rows + [(None, "en", "silent"), ("", "nowhere", "one"), (None, "nowhere", "two"), ("beta " * 100_000, "en", "s1"), rows[0]]


@pytest.mark.parametrize(("least", "tile", "columns"), [(3, 64, 1024), (30, 2, 8)])
def test_divergence_against_brute_force(spark, monkeypatch, least, tile, columns):
    # tasks get the sizes by value: tiles of two sources and blocks of a few indicator columns
    rows = spoken_rows()
    monkeypatch.setattr(dv, "TILE", tile)
    monkeypatch.setattr(dv, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(dv, "CELLS", 10 if tile == 2 else dv.CELLS)
    docs = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], "text string, lang string, source string, place bigint, n int").repartition(6)
    got = sorted(tuple(r) for r in dv.divergence(docs, least=least, ranks=7).collect())
    assert got == brute_divergence(rows, least, 7)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert dv.divergence(docs).count() == 0


@pytest.mark.parametrize("columns", [4, 64])
def test_joint_tables_hold_every_term(monkeypatch, columns):
    monkeypatch.setattr(dv, "BLOCK_COLUMNS", columns)
    draw = np.random.default_rng(2)
    levels = np.minimum(draw.zipf(1.5, (200, 6)), 40)
    left, right = np.arange(3), np.arange(2, 6)
    total = Counter()
    for _, a, b, table in dv.joint_tables(levels, left, right):
        for i, j in zip(*np.nonzero(table), strict=True):
            total[(*a[i].tolist(), *b[j].tolist())] += int(table[i, j])
    assert total == Counter((i, int(r[left[i]]), j, int(r[right[j]])) for r in levels for i in range(3) for j in range(4))
    whole = np.array([1000, 5, 77, 10**6, 12, 9])
    want = [[sum(abs(1 + 10**9 * (int(r[i]) + 5) // int(whole[i]) - 1 - 10**9 * (int(r[j]) + 5) // int(whole[j])) for r in levels) for j in right] for i in left]
    assert dv.priced(levels, whole, left, right).tolist() == want
