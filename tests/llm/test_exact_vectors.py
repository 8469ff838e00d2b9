"""Centroid clustering and exact top-k search against all distances and all scores, on odd tables."""

import hashlib
import math

import numpy as np
import pytest

from pagewatch.llm import centroid_clusters as C
from pagewatch.llm import exact_topk as T

SCHEMA = "vec_id long, embedding array<float>, x int, cell string, cluster int"


def cloud(n, dim, seed=3, spread=(0.02, 0.15, 0.6)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice(spread, (n, 1))).astype(np.float32)


def odd_rows(vectors, dim):
    """Rows with nulls, copies, repeated ids and vectors that take no part; the extra columns have clashing names."""
    rows = [(i * 5, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(i * 5 + 1, vectors[0].tolist()) for i in range(70)] + [(5, vectors[1].tolist())] * 2 + [(5, vectors[2].tolist()), (100, vectors[3].tolist())]
    rows += [(None, vectors[4].tolist()), (None, None), (3, None), (4, []), (6, [1.0] * (dim - 1) + [None]), (7, [1.0] * (dim - 1) + [math.nan]),
             (8, [math.inf] * dim), (9, [0.0] * dim)]
    return [(*r, 1, "a", 2) for r in rows]


def whole(vector, scale):
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


def plain_clusters(rows, clusters, rounds, dim):
    kept = [(i, x) for i, v, *_ in rows if (x := whole(v, 64)) is not None and len(x) == dim]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in start[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, of, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in kept), key=str), centroids


@pytest.mark.parametrize("clusters", [5, 400])
def test_clusters_equal_plain_rounds(spark, clusters):
    rows = odd_rows(cloud(150, 16), 16)
    found, centroids = C.cluster(spark.createDataFrame(rows, SCHEMA), clusters=clusters, dim=16)
    want, table = plain_clusters(rows, clusters, C.ROUNDS, 16)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == want
    got = {r["cluster"]: r for r in centroids.collect()}
    for j, r in got.items():
        mine = [d for _, c, d in want if c == j]
        assert (r["centroid"], r["size"], r["inertia"]) == (table[j], len(mine), sum(mine))
    assert set(got) == {c for _, c, _ in want}


def test_clusters_of_nothing_and_of_too_large_components(spark):
    found, centroids = C.cluster(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and centroids.count() == 0
    with pytest.raises(Exception, match="is not under"):
        C.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, "", 1)], SCHEMA))


def test_progressive_search_gives_up_only_worse_centroids():
    rng = np.random.default_rng(1)
    for scale in (1, 3, 1 << 20):
        x = rng.integers(-scale, scale + 1, (300, 64))
        x[::7] *= 0
        c = np.concatenate((x[:6], x[:2], x[:3] + 1))  # equal centroids: ties go to the smaller number
        cluster, distance, work = C.ProgressiveSearch(c).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
        assert work < x.shape[0] * len(c) * 64
    x = rng.integers(-9, 10, (400, 64)).cumsum(axis=1)
    _, _, work = C.ProgressiveSearch(x[:16]).nearest(x)
    assert work < 0.3 * len(x) * 16 * 64  # smooth vectors: most centroids go before the fine coefficients


def test_transform_is_exact_and_ordered_by_sign_changes():
    h = C.walsh_hadamard(np.eye(64, dtype=np.int64))
    assert (h.T @ h == 64 * np.eye(64)).all()
    assert ((h.T[:, 1:] != h.T[:, :-1]).sum(1) == np.arange(64)).all()


def plain_topk(rows, k, mod):
    data = [(i, x) for i, v, *_ in rows if i is not None and (x := whole(v, 1024)) is not None]
    best = {}
    for q, x in data:
        if q % mod == 0:
            for i, y in data:
                if i != q and len(x) == len(y):
                    s = sum(a * b for a, b in zip(x, y, strict=True))
                    best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, s))
    return sorted((q, r + 1, i, s) for q, of in best.items() for r, (s, i) in enumerate(sorted(((s, i) for i, s in of.items()), key=lambda z: (-z[0], z[1]))[:k]))


@pytest.mark.parametrize("sizes", [{}, {"page_rows": 16, "pivots": 4, "levels": 3, "group_rows": 4, "block_groups": 2}])
def test_topk_equals_all_scores(spark, sizes):
    rows = odd_rows(cloud(260, 8), 8) + [(i, [float(i), 1.0, 2.0], 1, "b", 3) for i in (10, 20, 31)] + [(200, [1.0, 2.0], 1, "c", 4)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = T.search(table, table.filter("vec_id % 10 = 0"), k=10, **sizes)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()) == plain_topk(rows, 10, 10)


def test_topk_of_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.search(none, none).count() == 0
    rows = [(100, [1.0, 0.0], 1, "", 1), (100, [1.0, 0.0], 1, "", 1), (7, [-1.0, 0.0], 1, "", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = T.search(table, table.filter("vec_id % 100 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in got] == [(100, 1, 7, -1024 * 1024)]
    assert T.search(none, table).count() == 0
    with pytest.raises(Exception, match="is not under"):
        T.search(spark.createDataFrame([(100, [1e9], 1, "", 1)], SCHEMA), table).collect()


def test_tree_covers_its_rows_and_prunes_clustered_data():
    x = np.floor(cloud(3000, 8, spread=(0.01,)) * 1024)
    tree = T.CoverTree(x)
    assert (tree.x == x[tree.order]).all()
    for (start, stop, first, end), centre, radius in zip(tree.bounds, tree.centre, tree.radius, strict=True):
        assert start <= centre < stop and (T._from(tree.x[start:stop], tree.x[centre]) <= radius).all()
        if end > first:
            assert tree.bounds[first][0] == start and tree.bounds[end - 1][1] == stop
            assert (tree.bounds[first + 1:end, 0] == tree.bounds[first:end - 1, 1]).all()
        else:
            assert stop - start <= T.LEAF or radius == 0
    tree.ids, tree.n_ids = np.arange(3000), np.ones(3000, np.int64)
    asks = T.CoverTree(x[:100], T.QUERY_LEAF)
    best = T.Best(100, 10)
    assert T.search_tree(asks, tree, best) < 0.5 * 100 * 3000
    full = asks.x @ tree.x.T
    assert (np.sort(full, axis=1)[:, -10] == best.worst).all()
