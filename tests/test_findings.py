"""What a review found on larger tables and odd inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from keelson import plans, session
from keelson.operators import curation, dense, evaluation, expansion, lexical, similarity as sim, topology
from keelson.registry import callables


def test_a_page_of_positives_only_is_kept(spark, tmp_path):
    """All forty neighbours have the query's label: no pair, but a row."""
    spark.range(60).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (1 + F.col("id") % 7 * i / 100).cast("float")).alias("embedding"), F.lit(3).alias("label"),
    ).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    plans.load()
    got = callables()["g14_pair_examples"](spark, str(tmp_path)).collect()
    assert got and {(r["positives"], r["pairs"]) for r in got} == {(40, 0)}


def test_rings_end_when_the_chains_have_ended(spark, monkeypatch):
    """Two thousand rows in rings and in chains of four: as many rounds as such a chain asks, not as the rows ask."""
    links = spark.range(2000).select("id", F.when(F.col("id") % 20 < 16, F.when(F.col("id") % 4 > 0, F.col("id") - 1)).otherwise(F.when(F.col("id") % 4 > 0, F.col("id") - 1).otherwise(F.col("id") + 3)).alias("predecessor"))
    rounds, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    got = {r["id"] for r in curation.cyclic_links(links).collect()}
    assert got == {i for i in range(2000) if i % 20 >= 16}
    assert len(rounds) <= 4


def test_a_hub_hands_on_no_more_than_a_list_takes(spark, monkeypatch):
    """Cut expansions are the nearest of the whole ones, and no table on the way holds a hub's leaves for every query."""
    draw = random.Random(5)
    pairs = {(f"q{i}", f"h{i % 2}") for i in range(20)} | {(f"h{i % 2}", f"leaf{i:04}") for i in range(1500)} | {(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(60)}
    pairs |= {(f"q{i}", f"n{i}") for i in range(20, 30)}
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, 1.0, "related_to") for a, b in sorted(pairs) if a != b], "edge_id string, src string, dst string, strength double, type string")
    seeds = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "query_id bigint, node string")
    whole = {}
    for r in expansion.graph_expand(seeds, edges, 3).where("hop > 0").collect():
        whole.setdefault(r["query_id"], []).append((r["hop"], r["path"], r["node"]))
    held, cut = [], session.cut_lineage
    monkeypatch.setattr(expansion, "cut_lineage", lambda df: held.append(cut(df)) or held[-1])
    got = {}
    for r in expansion.graph_expand(seeds, edges, 3, most_relations=16).where("hop > 0").collect():
        got.setdefault(r["query_id"], []).append((r["hop"], r["path"], r["node"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:16] for q, x in whole.items()}
    assert all(df.groupBy("query_id").count().where("count > 16").isEmpty() for df in held if "query_id" in df.columns) and len(held) == 4


def test_few_anchors_need_no_trigrams_of_the_texts(spark):
    texts = spark.createDataFrame([(1, "It was  HER hat the cat took"), (2, "nothing"), (3, None)], "id bigint, statement string")
    asked = spark.createDataFrame([(7, 'look for "at the"'), (8, 'look for "no"')], "query_id bigint, query string")
    out = lexical.surface_hits(asked, texts)
    assert [tuple(r) for r in out.collect()] == [(7, 1, "at the")]
    assert "gram" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_prints_and_their_keys_have_small_plans(spark):
    """Neither 64 sums nor hundreds of key expressions; characters beyond 16 bits count whole."""
    words = [["alpha", "beta", "beta"], ["\U00020000x", "y"]]
    prints = sim.simhash(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(8, ""), (9, None)], "id int, text string"))
    want = {}
    for i, w in enumerate([words[0], ["\U00020000", "x", "y"]]):
        sums = [0] * 64
        for token in w:
            h = 14695981039346656037
            for ch in token:
                h = (h ^ ord(ch)) * 1099511628211 % 2**64
            sums = [s + (1 if h >> b & 1 else -1) for b, s in enumerate(sums)]
        want[i] = sum(1 << b for b, s in enumerate(sums) if s > 0)
    assert {r["id"]: r["fingerprint"] % 2**64 for r in prints.collect()} == want
    assert len(sim.simhash_neighbours(prints, 6, 11)._jdf.queryExecution().analyzed().toString()) < 60_000


def test_components_gather_no_labels_in_the_driver(spark, monkeypatch):
    plans_, cut = [], topology.cut_lineage
    monkeypatch.setattr(topology, "cut_lineage", lambda df: plans_.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    topology.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans_[2:])


def test_similar_sets_meet_in_cells(spark, monkeypatch):
    """Parts and batches of a few tokens give what plain loops give; neither tokens nor candidate pairs become rows."""
    draw = random.Random(11)
    bases = [draw.sample(range(40), draw.randrange(1, 14)) for _ in range(12)]
    words = [[w for w in b if draw.random() < 0.85] for b in bases for _ in range(8)] + [[], [1], [1]]
    rows = [(i, draw.choice("xy"), " ".join(f"w{k}" for k in w)) for i, w in enumerate(words)]
    sets, want = {i: set(text.split()) for i, _, text in rows}, set()
    for i, node, _ in rows:
        near = [(-round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6), j) for j, other, _ in rows if i != j and node == other and sets[i] and sets[j]]
        want |= {(i, j, -s, r) for r, (s, j) in enumerate(sorted(x for x in near if x[0] <= -0.4)[:3], 1)}
    monkeypatch.setattr(sim, "CELL_TOKENS", 60)
    monkeypatch.setattr(sim, "CELL_PAIRS", 40)
    out = sim.similar_records(spark.createDataFrame(rows, "id bigint, node string, statement string"), ["node"], 0.4, 3)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Generate" not in plan and "array_intersect" not in plan


def test_a_cell_of_vectors_hands_on_k_rows_a_query(spark, monkeypatch):
    """Slices are merged, in the final order; blocks of few queries do not multiply the corpus."""
    import numpy as np

    draw = np.random.default_rng(3)
    rows, asked = draw.integers(-2, 3, (60, 4)).astype(float), draw.integers(-2, 3, (7, 4)).astype(float)
    monkeypatch.setattr(dense, "CELLS", 35)  # five rows a slice
    q, i, s = dense._score_block(np.arange(60), rows, np.arange(7), dense._unit_rows(list(asked)), 6, 0.0)
    want = []
    for n, v in enumerate(asked):
        size = (np.linalg.norm(rows, axis=1) * np.linalg.norm(v)) if v.any() else np.ones(60)
        cosine = np.round(rows @ v / np.where(size == 0, 1, size), 6)
        want += [(n, j, cosine[j]) for j in sorted((j for j in range(60) if cosine[j] > 0), key=lambda j: (-cosine[j], j))[:6]]
    assert sorted(zip(q, i, s)) == sorted(want)
    table = spark.range(40).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    plan = dense.vector_top_k(table, table.withColumnRenamed("id", "query_id"), 3, limit=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "[0,1,2,3,4,5,6,7,8,9]" not in plan


def test_scores_of_lists_from_hits_and_counts(spark):
    ranking = spark.createDataFrame([(q, i, r) for q in range(4) for r, i in enumerate(range(q, q + 5), 1)], "query_id int, id int, rank int")
    relevant = spark.createDataFrame([(q, i) for q in range(4) for i in range(0, 12, 2 + q)] + [(9, 1)], "query_id int, id int")
    one = evaluation.ranked_list_scores(ranking, relevant)
    two = evaluation.ranked_hit_scores(ranking.join(relevant, ["query_id", "id"]), relevant.groupBy("query_id").count().withColumnRenamed("count", "wanted"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 5


def test_terms_are_looked_for_once(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma", "en", "src1", 16), (2, "nothing", "en", "src1", 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha gamma delta" * 2)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plans.load()
    out = callables()["x3_lexical_text_score"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 10, 2), (1, 2, 0, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 2


def test_feedback_reads_the_first_page_once(spark, monkeypatch):
    """The first scores and the second queries are kept, not formed again for each use."""
    from keelson.plans import graph

    kept, cut = [], session.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    callables()["g9_relevance_feedback"](spark, "/root/testdata/sf0.001")
    assert kept == [["query_id", "id", "bm25"], ["query_id", "query"]]
