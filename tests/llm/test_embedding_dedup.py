import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewatch.llm import embedding_dedup as E


def brute(ids, vectors, labels, threshold):
    """n_links and component of each row by comparing all pairs."""
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and lab is not None
          for v, lab in zip(vectors, labels, strict=True)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    comp = [min(ids[k] for k in range(n) if find(k) == find(i)) for i in range(n)]
    return {ids[i]: (links[i], comp[i], comp[i] == ids[i]) for i in range(n)}


def cloud(n=260, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.6], (n, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("page_rows", [2048, 40])
def test_near_duplicates_equal_brute_force(spark, page_rows):
    x = cloud()
    labels = [None if i % 41 == 0 else 1 if i % 3 else 2 for i in range(len(x))]
    vectors = [v.tolist() for v in x]
    vectors[5], vectors[6], vectors[7], vectors[8] = None, [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [None]
    vectors[9] = [float("inf")] * 8
    vectors[10] = vectors[11] = vectors[13]
    labels[10] = labels[11] = labels[13] = 1
    ids = [int(i) for i in np.random.default_rng(1).permutation(1000)[:len(x)]]
    rows = spark.createDataFrame(list(zip(ids, vectors, labels, ids, strict=True)), "vec_id long, embedding array<float>, label int, key long")
    got = {r[0]: (r[1], r[2], r[3]) for r in E.near_duplicates(rows, page_rows=page_rows, threshold=0.95).select("id", "n_links", "component_id", "kept").collect()}
    assert got == brute(ids, vectors, labels, 0.95)


def test_empty_table_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 1.0], 1)], schema)
    got = sorted(E.near_duplicates(rows).collect(), key=str)
    assert sorted((r["n_links"], r["component_id"]) for r in got) == [(0, 4), (2, 3), (2, 3), (2, 3)]


def test_cover_tree_is_nested_and_covers():
    x = cloud().astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = E.CoverTree(x, np.ones(len(x), np.int64))
    radius = None
    for k, (centre, r, rows) in enumerate(zip(t.centre, t.radius, t.rows, strict=True)):
        for c, rad, s, e in zip(centre, r, rows, rows[1:], strict=False):
            assert s <= c < e
            assert np.all(np.sqrt(np.maximum(2 - 2 * t.x[s:e] @ t.x[c], 0)) <= rad + 1e-7)
        assert radius is None or r.max() <= radius
        radius = max(r.max(), 0)
        if k:
            assert set(t.centre[k - 1]) <= set(centre)
    assert len(t.centre[-1]) == len(x)


def test_dual_links_count_all_pairs_of_a_tight_group():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=16)[None] + rng.normal(size=(300, 16)) * 0.02, rng.normal(size=(200, 16))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = E.CoverTree(x, np.ones(len(x), np.int64))
    n, _, joined = E.dual_links(t, t, 0.98)
    full = x[t.order] @ x[t.order].T >= 0.98
    assert (n == full.sum(1) - 1).all()
    assert len(set(joined[n > 0])) == 1
