"""Spans of vectors and the clusters and partners found in them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewatch.operators import spans as S
from pagewatch.functions.text import markdown_to_plain
from pagewatch.operators.clustering import core_components, density_clusters
from pagewatch.operators.vectors import similarity_pairs
from test_clustering import brute_pairs, py_components


def mixed(n, dim=12, seed=8):
    """Dense groups, loose ones, single vectors, copies and zero vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim))
    x = base[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.03, 0.16, 0.22, 0.8], (n, 1))
    x[-8:-4], x[-4:] = x[0], 0
    return x


def span_of(x, ids, like, no=0):
    place = like.places(x)
    by = S._ordered(place)
    return S.Span(no, ids[by], x[by], place[by], np.zeros(len(x)), ids[by].copy())


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 16)
    monkeypatch.setattr(S, "BLOCK_ROWS", 24)
    monkeypatch.setattr(S, "VERIFY_ROWS", 7)


def plain_dbscan(x, threshold, min_pts, min_size):
    n = len(x)
    sims = brute_pairs(x, threshold)
    near = np.zeros((n, n))
    for (i, j), c in sims.items():
        near[i, j] = near[j, i] = c
    core = (near > 0).sum(1) + 1 >= min_pts
    comp = py_components(n, [(i, j) for i, j in sims if core[i] and core[j]])
    member = {i: comp[i] for i in range(n) if core[i]}
    for i in np.flatnonzero(~core):
        best = [(-near[i, j], j) for j in np.flatnonzero(near[i] * core)]
        if best:
            member[i] = comp[min(best)[1]]
    sizes = {c: sum(1 for m in member.values() if m == c) for c in set(member.values())}
    order = sorted((c for c in sizes if sizes[c] >= min_size), key=lambda c: (-sizes[c], c))
    return {i: order.index(member[i]) if member.get(i) in order else -1 for i in range(n)}


def test_pairs_of_two_spans_equal_brute_force(small_chunks):
    x = mixed(300)
    ids, limit = np.arange(300), S.Limit(0.95, 6)
    like = S._layout(x, 300, 150, None)
    a, b = span_of(x[:140], ids[:140], like), span_of(x[140:], ids[140:], like, 1)
    want = brute_pairs(x, 0.95)
    r, c, s = S.near_rows(a, np.arange(140), b, np.arange(160), limit)
    got = {(i, j): v for i, j, v in zip(a.id[r].tolist(), b.id[c].tolist(), s, strict=True)}
    assert len(got) == len(r) and got == {k: v for k, v in want.items() if k[0] < 140 <= k[1]}
    r, c, s = S.near_rows(a, np.arange(140), a, np.arange(140), limit)
    assert {(min(p), max(p)) for p in zip(a.id[r].tolist(), a.id[c].tolist(), strict=True)} == {k for k in want if k[1] < 140}
    # Of a row with many partners some are enough, of one with few all come; rows of b alike.
    r, c, _ = S.near_rows(a, np.arange(140), b, np.arange(160), limit, need=4, both=np.ones(160, bool))
    few = set(zip(a.id[r].tolist(), b.id[c].tolist(), strict=True))
    assert few < set(got)
    for side in (0, 1):
        for i in {k[side] for k in got}:
            all_, some = ({k for k in table if k[side] == i} for table in (set(got), few))
            assert some == all_ if len(all_) < 4 else len(some) >= 4


def test_groups_of_two_spans_are_joined_by_every_link(small_chunks):
    x = mixed(300)
    ids, limit = np.arange(300), S.Limit(0.95, 6)
    like = S._layout(x, 300, 150, None)
    a, b = span_of(x[:140], ids[:140], like), span_of(x[140:], ids[140:], like, 1)
    merged = S.Merged()
    for left, right in ((a, a), (a, b), (b, b)):
        S.join_rows(left, np.arange(len(left.id)), right, np.arange(len(right.id)), limit, merged)
    want = py_components(300, brute_pairs(x, 0.95))
    got = merged.of(ids)
    assert {i: got[i] for i in range(300)} == want
    assert len(merged.links) == 300 - len(set(want.values()))


def test_marks_of_a_span(small_chunks):
    x = mixed(200)
    ids = np.arange(200)
    ids[[3, 5]], ids[7] = 40, S.NULL_ID  # an id three times, and a null one
    like = S._layout(x, 200, 200, None)
    span = span_of(x, ids, like)
    limit = S.Limit(0.95, 6)
    mark, _ = S.core_marks(limit, 4)(span)
    unit = span.vec / np.maximum(np.linalg.norm(span.vec, axis=1), 1e-9)[:, None]
    sims = np.where(span.id[:, None] == span.id[None], -2, np.round(unit @ unit.T, 6))
    count = (sims >= 0.95).sum(1)
    assert (mark[span.id == S.NULL_ID] == S.DEAD).all()
    assert ((mark == S.CORE) == ((count >= 4) & (span.id != S.NULL_ID))).all()
    bound, _ = S.best_marks(limit, 2)(span)
    second = np.sort(np.where(np.eye(200, dtype=bool), -2, unit @ unit.T), axis=1)[:, -2]
    assert (bound <= np.maximum(second, 0.95)).all() and (bound > 0.96).any()


@pytest.mark.parametrize("block_size", [3, 5, 2048])
def test_density_clusters_of_many_spans_equal_plain_dbscan(spark, block_size):
    """Spans of 24 and 40 rows of one table, and one span: the same clusters as the plain method gives."""
    x = mixed(420)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id long, vec array<double>")
    df = df.unionByName(spark.createDataFrame([(None, x[0].tolist())], df.schema))
    got = {r["article_id"]: r["cluster"] for r in density_clusters(df.filter("article_id IS NOT NULL"), df, 0.97, 5, 4, block_size=block_size).collect()}
    want = plain_dbscan(x, 0.97, 5, 4)
    assert len(set(want.values())) >= 4 and got == want | {None: -1}


def test_a_null_id_is_a_neighbour_and_no_core(spark):
    """Three vectors and a null one: with it each has the three neighbours that it needs."""
    rows = [(i, [1.0, 0.0]) for i in (4, 5, 6)] + [(None, [1.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "article_id long, vec array<double>")
    got = {r["article_id"]: r["cluster"] for r in density_clusters(df, df, 0.9, 4, 3, block_size=1).collect()}
    assert got == {4: 0, 5: 0, 6: 0, None: -1, 9: -1}
    none = density_clusters(df.limit(0), df, 0.9, 4, 3).collect()
    assert {r["cluster"] for r in none} == {-1}


def test_a_core_is_not_held_against_all_vectors(spark):
    """One dense group: every vector has neighbours enough in its own span, so no pair of two spans is listed, and one group comes out."""
    rng = np.random.default_rng(2)
    x = np.ones(8) + 0.01 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").checkpoint()
    comp, near = core_components(df, 0.95, 5, span_rows=50)
    assert near.count() == 0
    assert {(r["id"], r["component"]) for r in comp.collect()} == {(i, 0) for i in range(400)}


def test_tables_that_meet_stand_on_the_same_axes(spark):
    """A table of a few of another one's vectors: places are only comparable on common axes."""
    x = mixed(400, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").withColumn("label", F.col("id")).checkpoint()
    layout = S.span_layout(df, 40)
    few = df.filter("id % 9 = 0")
    limit = S.Limit(0.95, 6)

    def run(batches):
        for a, b in S.met_spans(batches, one_table=False):
            r, c, s = S.near_rows(a, np.arange(len(a.id)), b, np.arange(len(b.id)), limit)
            from pagewatch.operators.vectors import batches_of
            yield from batches_of(i=a.id[r], j=b.id[c])

    left, right = (S.deal_spans(t, S.span_layout(t, 40, layout)) for t in (few, df))
    assert right.count() > 8
    got = {tuple(r) for r in S.meet_spans(left, limit, right).mapInArrow(run, "i long, j long").collect()}
    want = brute_pairs(x, 0.95)
    assert got == {(i, j) for p in want for i, j in (p, p[::-1]) if i % 9 == 0}


def test_best_partners_of_many_spans(spark):
    """Rows' marks leave out most products, and the best three partners of each vector come out, copies and ties among them."""
    x = mixed(420)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id long, vec array<double>")
    sims = brute_pairs(x, 0.9)
    want = set()
    for i in range(len(x)):
        near = sorted((-c, a + b - i) for (a, b), c in sims.items() if i in (a, b))[:3]
        want |= {(min(i, j), max(i, j), -c) for c, j in near}
    found = similarity_pairs(df, 0.9, max_neighbours=3, block_size=5)
    assert {tuple(r) for r in found.collect()} == want


def test_plain_text_of_markdown_in_one_pass_where_marks_are_absent(spark):
    """Ends are trimmed without a regex of their own, and texts without a mark are not searched for it."""
    rows = [" \u2003a  b\x1c\n c ", "[x](y) `z` **w** _v_", "## h\n`a` * b", "", None, "\x0b \u00a0", "a_b_c](d", " `*x*` "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "k int, t string")
    plain = markdown_to_plain("t")
    got = [r[0] for r in df.orderBy("k").select(plain).collect()]
    assert got == ["a b c", "x z w v", "h a * b", "", "", "", "abc](d", "x"]
    assert r"^ | \z" not in str(plain)
