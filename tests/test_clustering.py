"""Pairs, components and density clusters against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewatch.operators import cells
from pagewatch.operators.clustering import connected_components, dense_rank_ids, density_clusters
from pagewatch.operators.vectors import _banded, _pair_finder, core_graph, degrees, similarity_pairs


def py_components(n_nodes, edges):
    parent = list(range(n_nodes))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for v in range(n_nodes):
        comp.setdefault(find(v), []).append(v)
    return {v: min(c) for c in comp.values() for v in c}


def test_connected_components_matches_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(400, 460)]   # a long path: many hops
    df = spark.createDataFrame(edges, "i long, j long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    want = py_components(461, edges)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert set(got) == linked
    assert all(got[v] == want[v] for v in linked)


def test_components_of_a_hub_and_of_loops(spark):
    """One centre with most of all edges, a chain that hangs on it, a loop, and vertices without edges."""
    edges = [(5, i) for i in range(1000, 4000)] + [(i, i + 1) for i in range(4000, 4040)] + [(3999, 4000), (7, 7), (90, 80)]
    df = spark.createDataFrame(edges, "i long, j long")
    alone = spark.createDataFrame([(2,), (5,)], "id long")
    for contract in (True, False):
        got = {r["id"]: r["component"] for r in connected_components(df, alone, contract=contract).collect()}
        want = {i: 5 for i in [5, *range(1000, 4041)]} | {7: 7, 90: 80, 80: 80, 2: 2}
        assert got == want


def test_similarity_pairs_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    vecs = np.vstack([base[i % 6] + 0.05 * rng.normal(size=16) for i in range(180)])
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(180)], "article_id long, vec array<double>")
    got = {(r["i"], r["j"]) for r in similarity_pairs(df, 0.9, block_size=40).collect()}
    norm = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(norm @ norm.T, 6)
    want = {(i, j) for i in range(180) for j in range(i + 1, 180) if sims[i, j] >= 0.9}
    assert got == want


def clustered(groups, per, dim=16, noise=0.03, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    return base[np.arange(groups * per) % groups] + noise * rng.normal(size=(groups * per, dim))


def brute_pairs(x, threshold):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    sims = np.round(unit @ unit.T, 6)
    return {(i, j): sims[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if sims[i, j] >= threshold}


@pytest.mark.parametrize("threshold", [0.95, -0.2])
def test_cells_of_many_levels_lose_no_pair(spark, threshold):
    x = np.vstack((clustered(9, 25), np.zeros((2, 16)), np.random.default_rng(1).normal(size=(60, 16)), np.ones((30, 16))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").checkpoint()
    pages = cells.deal_pages(df, threshold, 6, 12, pivots=3)
    blocks = pages.blocks().toPandas()
    assert pages.rows.count() == len(x)
    assert threshold <= 0 or blocks["a"].str.len().max() >= 6  # two digits a level; without an angle nothing can be pruned
    assert blocks.groupby(["a", "b", "side"]).size().max() <= 3 * 12  # what no pivots part is dealt by hash
    met = set()
    for _, g in blocks.groupby(["a", "b"]):
        for i in g["id"][g["side"] == 0]:
            met |= {(min(i, j), max(i, j)) for j in g["id"][g["side"] == 1]}
    assert set(brute_pairs(x, threshold)) <= met


def test_copies_of_a_vector_do_not_grow_with_the_table(spark):
    """Twice the clusters, so twice the vectors: a vector still meets the pages of its own neighbourhood only."""
    copies = []
    for groups in (16, 32, 64):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(groups, 30, dim=24))], "id long, vec array<double>").checkpoint()
        n = cells.deal_pages(df, 0.95, 6, 60, pivots=64).blocks().count()
        copies.append(n / (groups * 30))
    assert max(copies) <= 1.5 * copies[0] and copies[-1] < 8, copies


def test_pages_meet_without_copies_of_their_vectors(spark):
    """Vectors without clusters, so all pages meet: no vector is shuffled for it, and a page is written once."""
    x = np.random.default_rng(4).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id long, vec array<double>")
    found = similarity_pairs(df, 0.9, block_size=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    assert {(r["i"], r["j"]) for r in found.collect()} == set(brute_pairs(x, 0.9))


def test_what_tasks_hand_on_grows_with_vectors_not_with_pages(spark):
    """All vectors are alike: a task gives one count a vector, one forest and the best partners, whatever pages it reads."""
    rows = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec")).checkpoint()
    pages = cells.deal_pages(rows, 0.9, 6, 10)
    met = pages.meetings()
    tasks = met.rdd.getNumPartitions()
    assert met.count() == 30 * 31 // 2 and tasks < 30
    best = met.mapInArrow(_pair_finder(0.9, 6, pages.angle, 2), "i long, j long, cosine double")
    assert best.count() <= 2 * 300 * tasks
    flags = rows.select("id", F.lit(True).alias("core"))
    assert core_graph(pages, flags, 0.9).count() <= 300 * tasks
    assert {(r["id"], r["degree"]) for r in degrees(pages, 0.9).collect()} == {(i, 299) for i in range(300)}


def test_a_vector_with_a_null_id(spark):
    """It is linked as any other, so its neighbours count it, and its id stays null."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "article_id long, vec array<double>")
    pairs = lambda **k: {tuple(r) for r in similarity_pairs(df, 0.9, **k).collect()}
    assert pairs() == {(1, 2, 1.0)}
    assert pairs(max_neighbours=3) == {(1, 2, 1.0), (1, 1, 1.0), (2, 2, 1.0), (None, None, 1.0)}
    pages = cells.deal_pages(df.withColumnRenamed("article_id", "id"), 0.9, 6, 10)
    assert {r["id"]: r["degree"] for r in degrees(pages, 0.9).collect()} == {1: 2, 2: 2, None: 3}


def test_components_compute_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 500)] + [(700, 700), (None, 800), (801, None), (None, None)], "i long, j long")
    got = {r["id"]: r["component"] for r in connected_components(edges.mapInPandas(count, edges.schema)).collect()}
    assert got == {i: 0 for i in range(500)} | {i: i for i in (700, 800, 801)}
    assert seen.value == 503


def test_lsh_finds_most_pairs_and_nothing_else(spark):
    x = np.abs(clustered(20, 15, noise=0.12)) + 0.3
    want = brute_pairs(x, 0.98)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, [0.0] * 16)], "article_id long, vec array<double>")
    got = [(r["i"], r["j"], r["cosine"]) for r in similarity_pairs(df, 0.98, method="lsh", block_size=20).collect()]
    assert len({g[:2] for g in got}) == len(got) and all(want[g[:2]] == g[2] for g in got)
    print("recall", len(got) / len(want))
    assert len(got) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        similarity_pairs(df, 0.98, method="guess")


def test_lsh_sends_a_vector_once_a_band(spark):
    x = clustered(20, 15, noise=0.12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id long, vec array<double>").withColumnRenamed("article_id", "id")
    whole = _banded(df, 0.98, 2048, 0.97)
    assert whole.groupBy("id", "band").count().filter("count <> 1").isEmpty()
    assert whole.select("id").distinct().count() == len(x)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    cut = _banded(df, 0.98, 10, 0.97)  # a vector of a group of several blocks once for each of them
    sizes = cut.groupBy("band", "key").agg(F.countDistinct("id").alias("n"), F.count("*").alias("rows"))
    assert sizes.filter("rows <> n * ceil(n / 10)").isEmpty() and not sizes.filter("n > 10").isEmpty()


@pytest.mark.parametrize("method", ["blocked", "lsh"])
def test_max_neighbours_keeps_the_best(spark, method):
    x = clustered(4, 30, noise=0.1)
    sims = brute_pairs(x, 0.9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id long, vec array<double>")
    got = {(r["i"], r["j"]) for r in similarity_pairs(df, 0.9, method=method, max_neighbours=2, block_size=25, recall=0.999999).collect()}
    want = set()
    for i in range(len(x)):
        near = sorted((-c, a + b - i) for (a, b), c in sims.items() if i in (a, b))[:2]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    assert got == want


def test_density_clusters_equal_plain_dbscan(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(5, 12))
    spread = rng.choice([0.03, 0.16, 0.22, 0.8], (220, 1))
    x = base[rng.integers(0, 5, 220)] + rng.normal(size=(220, 12)) * spread
    df = spark.createDataFrame([(i * 3, x[i].tolist()) for i in range(220)], "article_id long, vec array<double>")
    ids = spark.createDataFrame([(i * 3,) for i in range(220)] + [(9999,)], "article_id long")
    got = {r["article_id"]: r["cluster"] for r in density_clusters(df, ids, 0.97, 5, 4, block_size=40).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    near = (sims >= 0.97) & ~np.eye(220, dtype=bool)
    core = near.sum(1) + 1 >= 5
    comp = py_components(220, [(i, j) for i in range(220) for j in range(i) if near[i, j] and core[i] and core[j]])
    member = {i: comp[i] for i in range(220) if core[i]}
    for i in range(220):
        best = [(-sims[i, j], j) for j in range(220) if near[i, j] and core[j]]
        if not core[i] and best:
            member[i] = comp[min(best)[1]]
    sizes = {c: sum(1 for m in member.values() if m == c) for c in set(member.values())}
    order = sorted((c for c in sizes if sizes[c] >= 4), key=lambda c: (-sizes[c], c))
    assert len(order) >= 3 and any(not core[i] for i in member) and len(member) < 220
    want = {i * 3: order.index(member[i]) if member.get(i) in order else -1 for i in range(220)}
    assert got == want | {9999: -1}


def test_dense_rank_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r["k"], r["rank"]) for r in dense_rank_ids(df, ["k"], "rank").collect())
    assert got == [(i, i) for i in range(1000)]
