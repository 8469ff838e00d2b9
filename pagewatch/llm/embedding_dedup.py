"""Embedding near-duplicates by cover trees and dual traversal.

Equal vectors of a label are folded into one first. The vectors of a label are
then dealt to cells around pivots, full cells to cells around pivots of their
own, until one fits a page: the upper levels of the label's tree, each made by
one join. Pairs of cells are followed from the label's root down and dropped if
their covering radii allow no link, so only near pages ever meet. A page's
cover tree (nested levels whose radii halve) is built once and stored as a
row. A task walks the stored trees of a near pair at once: pairs of
nodes too far apart for any link are pruned, pairs whose members must all be
linked are counted as a whole. Links are exact; sums of links and the links of
a spanning forest leave the task, never all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import near_pages, reach, split_pages
from .common import connected_components, hot_join, merge_labels, write_table

THRESHOLD = 0.98
PAGE_ROWS = 2048       # vectors of a page: what a task holds is two pages
PIVOTS = 64            # cells that a cell is split into, at most
SLACK = 1e-7           # distances are bounds only; links are decided by the cosine itself
SLICE = 1 << 15        # pairs handled at once


def clean(vectors: DataFrame, vector_col: str) -> DataFrame:
    """``vectors`` with ``v``: the vector in double precision, null where it takes no part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)  # NaN is above infinity
    return vectors.withColumn("v", F.when(fine, v))


class CoverTree:
    """Nested levels over unit vectors: a level's balls have half the radius of the level above; leaves are single vectors.

    Rows stand so that each node's rows are consecutive. Per level: ``centre``
    (row of each node's centre), ``radius`` (largest distance from it to a row
    of the node), ``rows`` (bounds of the nodes' rows) and ``child`` (bounds of their children).
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        apart = _distance(x, x)
        np.fill_diagonal(apart, 0)
        levels = [(np.zeros(1, np.int64), np.zeros(len(x), np.int64), apart[0])]
        r = float(apart[0].max())
        while len(levels[-1][0]) < len(x):
            r /= 2
            levels.append(_split(apart, *levels[-1], r) if r > SLACK else (np.arange(len(x)), np.arange(len(x)), np.zeros(len(x))))
        order = np.lexsort(tuple(owner for _, owner, _ in reversed(levels)))
        place = np.argsort(order)
        self.order, self.x, self.weight = order, x[order], weight[order]
        self.centre, self.radius, self.rows = [], [], []
        for centre, owner, dist in levels:
            o = owner[order]
            start = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            self.centre.append(place[centre[o[start]]])
            self.radius.append(np.maximum.reduceat(dist[order], start))
            self.rows.append(np.concatenate((start, [len(x)])))
        self.child = [np.searchsorted(self.rows[k + 1], self.rows[k]) for k in range(len(levels) - 1)]
        self.deep = len(levels) - 1
        self.cum = np.concatenate(([0], np.cumsum(self.weight)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _split(apart, centre, owner, dist, r):
    """(centres, owners, distances) of balls of radius ``r`` inside each node; the old centre stays one, so levels are nested."""
    centres = centre.tolist()
    owner, dist = owner.copy(), dist.copy()
    left = np.flatnonzero(dist > r)
    left = left[np.argsort(owner[left], kind="stable")]
    for rest in np.split(left, np.flatnonzero(owner[left][1:] != owner[left][:-1]) + 1):
        while len(rest):
            d = apart[rest[0], rest]
            inside = d <= r
            owner[rest[inside]], dist[rest[inside]] = len(centres), d[inside]
            centres.append(int(rest[0]))
            rest = rest[~inside]
    return np.array(centres), owner, dist


def dual_links(a: CoverTree, b: CoverTree, threshold: float):
    """(weight linked to each row of ``a``, to each row of ``b``, components of a's rows followed by b's).

    ``b is a``: every pair is looked at once, the first array then holds all.
    """
    same = a is b
    reach = np.sqrt(2 - 2 * threshold)
    to_a = np.zeros(len(a.x), np.int64)
    to_b = to_a if same else np.zeros(len(b.x), np.int64)
    shift = 0 if same else len(a.x)
    joined = np.arange(len(a.x) + (0 if same else len(b.x)))
    zero = np.zeros(1, np.int64)
    todo = [(0, 0, zero, zero)]
    while todo:
        ka, kb, i, j = todo.pop()
        ra, rb = a.radius[ka][i], b.radius[kb][j]
        d = _row_distance(a.x[a.centre[ka][i]], b.x[b.centre[kb][j]])
        own = (i == j) & (ka == kb) if same else np.zeros(len(i), bool)
        d[own] = 0
        if ka == a.deep and kb == b.deep:
            cos = np.einsum("ij,ij->i", a.x[a.centre[ka][i]], b.x[b.centre[kb][j]])
            hit = (cos >= threshold) & ~own
            i, j = i[hit], j[hit]
            np.add.at(to_a, i, b.weight[j])
            np.add.at(to_b, j, a.weight[i])
            joined = merge_labels(joined, i, j + shift)
            continue
        every = d + ra + rb + SLACK < reach
        for p, q, alone in zip(i[every], j[every], own[every], strict=True):
            sa, sb = slice(a.rows[ka][p], a.rows[ka][p + 1]), slice(b.rows[kb][q], b.rows[kb][q + 1])
            to_a[sa] += b.cum[sb.stop] - b.cum[sb.start]
            if alone:
                to_a[sa] -= a.weight[sa]
            else:
                to_b[sb] += a.cum[sa.stop] - a.cum[sa.start]
            rows = np.concatenate((np.arange(sa.start, sa.stop), np.arange(sb.start, sb.stop) + shift))
            joined = merge_labels(joined, np.full(len(rows) - 1, rows[0]), rows[1:])
        go = ~every & (d - ra - rb - SLACK <= reach)
        i, j = i[go], j[go]
        na, nb = min(ka + 1, a.deep), min(kb + 1, b.deep)
        for p in range(0, len(i), SLICE):
            for ci, cj in _children(a, b, ka, kb, na, nb, i[p:p + SLICE], j[p:p + SLICE], same, reach):
                for s in range(0, len(ci), SLICE):
                    todo.append((na, nb, ci[s:s + SLICE], cj[s:s + SLICE]))
    return to_a, to_b, joined


def _row_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a, b), 0))


def _children(a, b, ka, kb, na, nb, i, j, same, reach):
    """Pairs of children of node pairs (i, j); a pair with many is compared by one matrix product and pruned at once."""
    ia = np.stack((a.child[ka][i], a.child[ka][i + 1])) if na > ka else np.stack((i, i + 1))
    jb = np.stack((b.child[kb][j], b.child[kb][j + 1])) if nb > kb else np.stack((j, j + 1))
    many = (ia[1] - ia[0]) * (jb[1] - jb[0]) >= 256
    for p in np.flatnonzero(many):
        sb = slice(jb[0, p], jb[1, p])
        for top in range(ia[0, p], ia[1, p], 1024):
            sa = slice(top, min(top + 1024, ia[1, p]))
            d = _distance(a.x[a.centre[na][sa]], b.x[b.centre[nb][sb]])
            ci, cj = np.nonzero(d <= a.radius[na][sa][:, None] + b.radius[nb][sb][None, :] + reach + SLACK)
            ci, cj = ci + sa.start, cj + sb.start
            once = ci <= cj if same else slice(None)
            yield ci[once], cj[once]
    few = np.flatnonzero(~many)
    if len(few):
        ci, at = _expand(ia[:, few])
        cj, up = _expand(jb[:, few][:, at])
        ci = ci[up]
        once = ci <= cj if same else slice(None)
        yield ci[once], cj[once]


def _expand(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each is from."""
    n = bounds[1] - bounds[0]
    which = np.repeat(np.arange(len(n)), n)
    return bounds[0][which] + np.arange(n.sum()) - (np.cumsum(n) - n)[which], which


def _trees(rows: DataFrame) -> DataFrame:
    """(path, part, tree): a row a page, with its cover tree and the keys of its rows."""
    def build(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        page = page.sort_by([("id", "ascending")])
        x = page.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(page), -1)
        tree = CoverTree(x, page.column("w").to_numpy())
        tree.keys = page.column("id").to_numpy()[tree.order]
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "tree": pa.array([pickle.dumps(tree.__dict__)], pa.binary())})

    return rows.groupBy("path", "part").applyInArrow(build, "path string, part int, tree binary")


def _load(blob: bytes) -> CoverTree:
    tree = CoverTree.__new__(CoverTree)
    tree.__dict__ = pickle.loads(blob)
    return tree


def _links(trees: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(key, n, root): per pair of pages and vector with links there, the weight linked and a vector of its component."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second in zip(batch.column(0), batch.column(1), strict=True):
                a = _load(first.as_py())
                b = _load(second.as_py()) if second.is_valid else a
                to_a, to_b, joined = dual_links(a, b, threshold)
                n, key = (to_a, a.keys) if a is b else (np.concatenate((to_a, to_b)), np.concatenate((a.keys, b.keys)))
                linked = n > 0
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[linked]), pa.array(n[linked]), pa.array(key[joined[linked]])], ["key", "n", "root"])

    mine = trees.select(F.col("path").alias("a"), F.col("part").alias("pa"), F.col("tree").alias("first"))
    other = trees.select(F.col("path").alias("b"), F.col("part").alias("pb"), F.col("tree").alias("second"))
    both = pairs.filter("a <> b OR pa <> pb").select("a", "pa", "b", "pb").join(mine, ["a", "pa"]).join(other, ["b", "pb"]).select("first", "second")
    own = mine.select("first", F.lit(None).cast("binary").alias("second"))  # every page with itself: its tree stays where it is
    return both.unionByName(own).mapInArrow(walk, "key long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, page_rows: int = PAGE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Only vectors of equal label and length are compared; those with a null
    label, and vectors that are null, zero or hold null or non-finite
    components, have no links and are their own component. Rows with a null
    id link like others (their component may then be null). Repeated rows are vectors of their own. An
    empty table gives an empty result.
    """
    rows = clean(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("e"),
                                F.col(f"`{label_col}`").cast("string").alias("label")), "e")
    takes_part = F.col("v").isNotNull() & F.col("label").isNotNull()
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    rows = rows.select("id", F.when(takes_part, F.concat_ws("/", F.size("v").cast("string"), "label")).alias("label"), scaled.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = write_table(rows.select("id", "label", F.transform("v", lambda x: x / norm + 0.0).alias("u")), "cover_rows")
    apart = rows.filter("label IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = rows.filter("label IS NOT NULL")
    folded = rows.groupBy("label", "u").agg(F.min("id").alias("first"), F.count("*").alias("w"))
    folded = write_table(folded.withColumn("key", F.monotonically_increasing_id()), "cover_folded")

    points = folded.select(F.col("key").alias("id"), F.col("u").alias("vec"), "w", F.concat("label", F.lit("|")).alias("path"))
    roots = write_table(points.groupBy("path").agg(F.count("*").alias("n")), "cover_labels")
    paged, cells = split_pages(points, roots, page_rows, pivots)
    pairs = near_pages(cells, roots, page_rows, reach(threshold, 9))
    trees = write_table(_trees(paged), "cover_trees")
    found = write_table(_links(trees, pairs, threshold), "cover_links")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = connected_components(found, "key", "root").withColumnRenamed("node", "key")
    folded = write_table(folded.join(counts, "key", "left").join(roots, "key", "left")
                         .select("label", "u", "w", "first", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "cover_roots")
    first = folded.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    folded = write_table(hot_join(folded, first, ["root"], "m", folded.count()).select("label", "u", "w", "n_links", "component_id"), "cover_components")
    linked = hot_join(rows, folded, ["label", "u"], "w", rows.count()).select("id", "n_links", "component_id")
    return linked.unionByName(apart).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
