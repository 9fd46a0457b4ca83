"""What the fourth review found, on small tables."""

from __future__ import annotations

import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from keelson import plans
from keelson.operators import similarity as sim, topology
from keelson.registry import REGISTRY, Tables

#: Words beside letters that are not ASCII, other letters of the same case fold, other blanks, no text.
PROMPTS = (
    "ätestö", "Öfix it", "try\u00e9 n", "bétest it", "le\u017fte\u017ft", "te\u017ft", "\u212aey\u212a-a", "abc\u017f/\u212a", "a\u000bgo\u000bon", "go\u000bon", "go \t on", "again\u00a0",
    "\u00a0build", "_test_", "test", "testing", "x.yz/q", "retry!", None, "x" * 40, "y" * 500, "proceed " + "z" * 92, "proceed " + "z" * 93,
)


@pytest.mark.parametrize("name", ["t7_task_window", "t7_window_stream"])
def test_words_of_a_prompt_end_as_in_sql(spark, tmp_path, name):
    """Every prompt between two others, in sessions of 40 prompts, some of which follow an anchor and some none."""
    rows = [(s, 40 * s + 6 * i + j, "user", x) for s in range(3) for i, p in enumerate(PROMPTS) for j, x in enumerate((p, "again", f"configure {i}", p, "go on", PROMPTS[(i + s) % len(PROMPTS)]))]
    spark.createDataFrame([(s, n % 1000, role, x) for n, (s, _, role, x) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    plans.load()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    entry = REGISTRY[name]
    status, count, *_, note = oracle.compare(spark, lambda s, d: entry.build(Tables(s, d)), entry.sql, str(tmp_path), con)
    assert (status, note) == ("OK", "") and count > 200


@pytest.mark.parametrize("part", [7, 100, 16_384])
def test_prints_meet_in_cells_and_pairs_are_made_once(spark, monkeypatch, part):
    """A key of most prints in parts, small keys together; no pair is shuffled to be made distinct."""
    monkeypatch.setattr(sim, "KEY_PRINTS", part)
    monkeypatch.setattr(sim, "TILE", (8, 32))
    monkeypatch.setattr(sim, "PAIR_ROWS", 50)
    draw = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(64), n))
    prints = [flip(0x9E3779B97F4A7C15, draw.randrange(7)) for _ in range(150)] + [draw.getrandbits(64) for _ in range(150)]
    prints += [flip(x, draw.randrange(9)) for x in prints[150:]]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    near = lambda a, b: (a ^ b).bit_count() if a >= 0 <= b else ((a ^ b) % 2**64).bit_count()
    frame = lambda some: spark.createDataFrame([(x,) for x in some], "fingerprint bigint")
    out = sim.simhash_neighbours(frame(signed + signed[:20]), 6, 7)
    rows = [tuple(r) for r in out.collect()]
    want = {(a, b, near(a, b)) for a in set(signed) for b in set(signed) if a < b and near(a, b) <= 6}
    assert set(rows) == want and len(rows) == len(want) > 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")
    left, right = signed[:200] + signed[300:330], signed[100:]
    rows = [tuple(r) for r in sim.simhash_matches(frame(left), frame(right), 6, 8).collect()]
    want = {(a, b, near(a, b)) for a in set(left) for b in set(right) if near(a, b) <= 6}
    assert set(rows) == want and len(rows) == len(want) > 1000


def test_moved_snippets_are_found_by_anchors(spark, monkeypatch):
    """Of many texts that resemble each other only those that hold the snippet are looked at."""
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcde fgh\nö\U00020000") for _ in range(n))
    bodies = [text(draw.randrange(20, 300)) for _ in range(60)]
    snippets = [b[len(b) // 2 :][: draw.randrange(38, 60)] for b in bodies] + [text(40) for _ in range(20)]
    bodies += [text(30) + s + text(30) for s in snippets[:40]] + ["same " + snippets[1]] * 3
    files = [(f"f{i:03}", draw.choice((0, 1, 255, 2047)), b) for i, b in enumerate(bodies)]
    print_of = {b: p for _, p, b in files}
    files = [(path, print_of[b], b) for path, _, b in files]
    marks = [(i, f"f{i % 50:03}" if i % 5 == 0 else "gone", draw.choice((0, 3, 255, -1)), s) for i, s in enumerate(snippets)]
    seen, line_of = [], sim.line_of
    monkeypatch.setattr(sim, "line_of", lambda t, s: seen.append(1) or line_of(t, s))
    out = sim.relocate(spark.createDataFrame(marks, "id int, path string, fingerprint bigint, snippet string"), spark.createDataFrame(files, "path string, fingerprint bigint, text string"))
    held = {path: (p, b) for path, p, b in files}
    near = lambda a, b: ((a ^ b) % 2**64).bit_count() <= 6
    want = {}
    for i, path, p, s in marks:
        if path in held and s in held[path][1]:
            want[i] = ("in_place", path)
        elif path in held and near(p, held[path][0]):
            want[i] = ("stale", path)
        else:
            found = min((x for x, (q, b) in held.items() if x != path and near(p, q) and s in b), default=None)
            want[i] = ("moved" if found else "lost", found)
        want[i] += (held[want[i][1]][1].split(s)[0].count("\n") + 1 if want[i][0] in ("in_place", "moved") else None,)
    assert {r["id"]: (r["status"], r["path"], r["line"]) for r in out.collect()} == want
    assert {x[0] for x in want.values()} == {"in_place", "stale", "moved", "lost"}


def test_prints_that_resemble_make_no_pairs_to_find_a_snippet(spark, monkeypatch):
    """Forty characters have an anchor: prints are not matched at all."""
    monkeypatch.setattr(sim, "simhash_matches", None)
    files = spark.createDataFrame([("a", 0, "x" * 20 + "0123456789" * 5), ("b", 0, "y" * 90)], "path string, fingerprint bigint, text string")
    marks = spark.createDataFrame([(1, "z", 1, "0123456789" * 4), (2, "z", 1, "9876543210" * 4)], "id int, path string, fingerprint bigint, snippet string")
    assert {r["id"]: (r["status"], r["path"]) for r in sim.relocate(marks, files).collect()} == {1: ("moved", "a"), 2: ("lost", None)}


def test_key_clusters_are_formed_once_and_gathered_nowhere(spark, tmp_path, monkeypatch):
    """The forest is kept before its components read it three times; their names are not broadcast through the driver."""
    spark.range(30).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.cos(F.col("id") * i).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"),
    ).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    plans.load()
    seen, components = [], topology.connected_components
    monkeypatch.setattr(topology, "connected_components", lambda pairs: seen.append(pairs._jdf.queryExecution().executedPlan().toString()) or components(pairs))
    out = REGISTRY["g6_key_canonicalisation"].build(Tables(spark, str(tmp_path)))
    assert len(seen) == 1 and "FlatMapGroupsInPandas" not in seen[0]
    assert out.count() == 30 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
