"""Exact top-k search by inner product: dual-tree traversal of cover trees.

Queries and data are indexed together. Equal vectors are folded into one; the
rest is dealt to cells around pivots, cells within cells until one fits a page
(the upper levels of the index), and every page gets a cover tree of its own,
built once and stored as a row. While it is built the page's queries are
searched in it, which gives each query a first worst kth score.

Queries of neighbouring cells then form groups of bounded size with trees of
their own. Groups are sent to the pages in blocks, so no page is ever moved.
A pair of nodes is pruned if the inner product of their centres and their
covering radii leave no score as high as the worst kth score in the query node;
that score rises from page to page. Components are integers small enough that
every inner product is exact in double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_join, write_table
from .integer_vectors import integer_rows, matrix

SCALE = 1024           # a component x becomes floor(SCALE * x)
LIMIT = 1 << 21        # components are smaller: sums of up to 2^10 products are exact in double precision
PAGE_ROWS = 2048       # vectors of a page
PIVOTS = 256           # cells that a cell is split into, at most
LEVELS = 6             # splits; what is then larger than a page is dealt by hash
GROUP_ROWS = 1024      # queries of a group
BLOCK_GROUPS = 32      # groups that are sent to all pages at once
CHUNK_ROWS = 1 << 14   # rows that a task compares with the pivots of their cell
LEAF = 64              # rows of a node that is not split further
QUERY_LEAF = 16        # the same for trees of queries
MIN_BALLS = 32         # children of a node that a node may always have
FLUSH = 2048           # candidates that are held before the worst kth scores are brought up to date
SLACK = 1e-9           # relative, added to bounds: they are rounded, scores are not


class CoverTree:
    """Nested levels of balls over the rows of ``x``; radii halve from level to level until a node has at most ``leaf`` rows.

    Rows stand so that each node's are consecutive; ``order`` says where they came from. ``bounds`` of a node: its first
    row, its end, its first child and the end of its children (none: a leaf).
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        nodes, i = [[0, len(x), 0, 0, 0, float(_from(x, x[0]).max())]], 0
        while i < len(nodes):
            start, stop, _, _, centre, radius = nodes[i]
            if stop - start > leaf and radius > 0:
                balls = _split(x, order[start:stop], centre, radius / 2, leaf)
                nodes[i][2:4] = len(nodes), len(nodes) + len(balls)
                for rows, c, r in balls:
                    order[start:start + len(rows)] = rows
                    nodes.append([start, start + len(rows), 0, 0, c, r])
                    start += len(rows)
            i += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.order, self.x = order, x[order]
        self.bounds = np.array([n[:4] for n in nodes])
        self.centre = place[[n[4] for n in nodes]]
        self.radius = np.array([n[5] for n in nodes]) * (1 + SLACK)
        self.norm = np.sqrt((self.x[self.centre] ** 2).sum(1))

    def stored(self, **more) -> bytes:
        return pickle.dumps({"x": self.x.astype(np.int32), "bounds": self.bounds, "centre": self.centre, "radius": self.radius, "norm": self.norm, **more})

    @classmethod
    def load(cls, blob: bytes) -> "CoverTree":
        """The tree as it was stored, with what was stored beside it."""
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(blob)
        tree.x = tree.x.astype(float)
        return tree


def _from(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


def _split(x: np.ndarray, rows: np.ndarray, centre: int, radius: float, leaf: int):
    """(rows, centre, covering radius) of balls that cover ``rows``; the old centre stays one, so levels are nested.

    Centres are at least ``radius`` apart, each row goes to the first that covers it.
    Where that would take very many, what is left joins its nearest centre.
    """
    left, balls = rows, []
    while len(left) and len(balls) < max(MIN_BALLS, len(rows) // leaf):
        d = _from(x[left], x[centre])
        inside = d <= radius
        balls.append([left[inside], centre, float(d[inside].max())])
        left = left[~inside]
        centre = int(left[0]) if len(left) else -1
    if len(left):
        d = np.stack([_from(x[left], x[c]) for _, c, _ in balls])
        near = d.argmin(0)
        for i in np.unique(near):
            balls[i][0] = np.concatenate((balls[i][0], left[near == i]))
            balls[i][2] = max(balls[i][2], float(d[i][near == i].max()))
    return balls


class Best:
    """The best ``k`` of each query so far: ids and scores, best first, ties to smaller ids."""

    def __init__(self, queries: int, k: int, worst: np.ndarray | None = None):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.worst = np.full(queries, -np.inf) if worst is None else worst.copy()

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray):
        query, ids, score = np.concatenate((self.query, query)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.lexsort((-score, ids, query))
        query, ids, score = query[order], ids[order], score[order]
        once = np.ones(len(query), bool)
        once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])  # a repeated id counts once, with its highest score
        query, ids, score = query[once], ids[once], score[once]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        full = rank == self.k - 1
        self.worst[query[full]] = np.maximum(self.worst[query[full]], score[full])

    def add_rows(self, found: list[tuple], data: CoverTree):
        """Scores of rows of ``data``, each of which stands for all ids that have its vector."""
        row, at, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else ([], [], [])
        if len(row):
            n = data.n_ids[at]
            ids = data.ids[np.repeat((np.cumsum(data.n_ids) - data.n_ids)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self.add(np.repeat(row, n), ids, np.repeat(score, n))


def search_tree(asks: CoverTree, data: CoverTree, best: Best) -> int:
    """Put into ``best`` what ``data`` has for the rows of ``asks``; returns how many scores were computed.

    Node pairs are walked from both roots, those with the highest bounds first;
    a pair is pruned if no score in it can reach the worst kth score of its queries.
    """
    work, held, n = 0, [], 0
    todo = [(0, 0, np.inf)]
    while todo:
        p, q, bound = todo.pop()
        start, stop = asks.bounds[p, :2]
        if bound < best.worst[start:stop].min():
            continue  # the worst kth score has risen since
        mine, other = _children(asks, p), _children(data, q)
        if mine is None and other is None:
            begin, end = data.bounds[q, :2]
            score = asks.x[start:stop] @ data.x[begin:end].T
            work += score.size
            row, at = np.nonzero(score >= best.worst[start:stop, None])
            held.append((row + start, at + begin, score[row, at]))
            n += len(row)
            if n > FLUSH:
                best.add_rows(held, data)
                held, n = [], 0
            continue
        mine, other = np.array([p]) if mine is None else mine, np.array([q]) if other is None else other
        bound = _bound(asks, data, mine, other)
        worst = np.array([best.worst[a:b].min() for a, b in asks.bounds[mine, :2]])
        i, j = np.nonzero(bound >= worst[:, None])
        order = np.argsort(bound[i, j], kind="stable")
        todo += list(zip(mine[i[order]], other[j[order]], bound[i, j][order], strict=True))
    best.add_rows(held, data)
    return work


def _children(tree: CoverTree, node: int) -> np.ndarray | None:
    first, stop = tree.bounds[node, 2:]
    return np.arange(first, stop) if stop > first else None


def _bound(asks: CoverTree, data: CoverTree, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No row of node p and row of node q have a higher inner product."""
    centre = asks.x[asks.centre[p]] @ data.x[data.centre[q]].T
    a, b, r, s = asks.norm[p][:, None], data.norm[q][None, :], asks.radius[p][:, None], data.radius[q][None, :]
    return centre + (a * s + r * b + r * s) * (1 + SLACK) + SLACK * a * b


def _folded(data: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """(key, x, ids, asks): distinct vectors, the smallest ids of each (no query can have more than ``keep``), and whether one asks."""
    none = F.lit(None).cast("long")
    rows = data.filter("id IS NOT NULL").select("x", "id").unionByName(asked.select("x", none.alias("id"))).distinct()
    rows = rows.withColumn("key", F.xxhash64("x"))
    order = W.partitionBy("key", "x").orderBy(F.col("id").asc_nulls_first())
    few = rows.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= keep + 1)
    return few.groupBy("key", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max(F.col("id").isNull()).alias("asks"))


def _pages(rows: DataFrame, page_rows: int, pivots: int, levels: int) -> DataFrame:
    """``rows`` with ``cell``, the path of cells (two digits a level) down to a page; a level moves the rows once."""
    rows = write_table(rows.withColumn("cell", F.lit("")), "topk_rows")
    moved = rows
    done = None
    for _ in range(levels):
        sizes = moved.groupBy("cell").agg(F.count("*").alias("n"))
        split = write_table(sizes.filter(F.col("n") > page_rows), "topk_split")
        if split.isEmpty():
            break
        stays = moved.join(split, "cell", "left_anti")
        done = stays if done is None else done.unionByName(stays)
        # Pivots of a cell: its vectors that come first by hash, about two a page.
        split = split.withColumn("wanted", F.least(F.lit(pivots), F.ceil(F.col("n") * 2 / page_rows)).cast("int"))
        big = moved.join(split, "cell")
        h = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(1 << 40))
        near = big.withColumn("h", h).filter(F.col("h") < (F.col("wanted") * 2.0 + 64) / F.col("n") * (1 << 40))
        rank = F.row_number().over(W.partitionBy("cell").orderBy("h", "key", "x"))
        picked = near.withColumn("no", rank).filter(F.col("no") <= F.col("wanted"))
        # A cell is dealt to chunks of bounded size, each of which gets the cell's pivots.
        chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
        chunk = F.pmod(F.xxhash64("key", F.lit("chunk")), chunks).cast("int")
        to = write_table(picked.select("cell", "x", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")), "topk_pivots")
        rows = big.select("cell", chunk.alias("chunk"), "key", "x", "ids", "asks")
        moved = rows.groupBy("cell", "chunk").cogroup(to.groupBy("cell", "chunk")).applyInArrow(_to_nearest, rows.drop("chunk").schema)
        moved = write_table(moved, "topk_rows")
    rows = moved if done is None else done.unionByName(moved)
    # Whatever is still larger than a page (vectors that no pivot parts) is dealt by hash.
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / page_rows).cast("int").alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int"), F.lit(0))
    return rows.join(parts, "cell", "left").select("key", "x", "ids", "asks", "cell", part.alias("part"))


def _to_nearest(key: tuple[pa.Scalar, ...], rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Rows of a cell with the number of their nearest pivot added to the path."""
    cell, rows = key[0].as_py(), rows.drop_columns(["chunk"])
    if not len(rows):
        return rows
    names = rows.column_names
    x = matrix(rows.column("x").combine_chunks()).astype(float)
    p = np.unique(matrix(pivots.column("x").combine_chunks()), axis=0).astype(float) if len(pivots) else x[:1]
    near = ((p ** 2).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
    path = pa.array([f"{cell}{i:02x}" for i in near], pa.string())
    return pa.table({n: path if n == "cell" else rows.column(n) for n in names})


def _trees(pages: DataFrame, k: int) -> DataFrame:
    """A row a page: its tree, and its queries with the worst kth scores found in it."""
    def build(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        page = page.sort_by([("key", "ascending")])
        tree = CoverTree(matrix(page.column("x").combine_chunks()).astype(float))
        ids = [page.column("ids")[int(i)].as_py() for i in tree.order]
        tree.n_ids, tree.ids = np.array([len(v) for v in ids]), np.array([i for v in ids for i in v], np.int64)
        asks = tree.x[page.column("asks").to_numpy(zero_copy_only=False)[tree.order]]
        worst = np.zeros(0)
        if len(asks):
            queries = CoverTree(asks, QUERY_LEAF)
            best = Best(len(asks), k)
            search_tree(queries, tree, best)
            asks, worst = queries.x, best.worst
        return pa.table({"cell": pa.array([key[0].as_py()], pa.string()), "tree": pa.array([tree.stored(ids=tree.ids, n_ids=tree.n_ids)], pa.binary()),
                         "asks": pa.array([asks.astype(np.int32).tolist()], pa.list_(pa.list_(pa.int32()))),
                         "worst": pa.array([worst.tolist()], pa.list_(pa.float64()))})

    return pages.groupBy("cell", "part").applyInArrow(build, "cell string, tree binary, asks array<array<int>>, worst array<double>")


def _groups(trees: DataFrame, group_rows: int) -> DataFrame:
    """A row a group of queries, neighbours by their path of cells: their tree with their worst kth scores."""
    asked = trees.select("cell", F.explode(F.arrays_zip("asks", "worst")).alias("q")).select("cell", F.col("q.asks").alias("x"), "q.worst")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, worst = [], []

        def group() -> pa.RecordBatch:
            tree = CoverTree(np.array(x, float), QUERY_LEAF)
            return pa.RecordBatch.from_arrays([pa.array([tree.stored(worst=np.array(worst)[tree.order])], pa.binary())], ["queries"])

        for batch in batches:
            for v, w in zip(matrix(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                x.append(v)
                worst.append(w)
                if len(x) == group_rows:
                    yield group()
                    x, worst = [], []
        if x:
            yield group()

    near = asked.repartitionByRange("cell", "x").sortWithinPartitions("cell", "x").select("x", "worst")
    return near.mapInArrow(cut, "queries binary").withColumn("no", F.monotonically_increasing_id())


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           page_rows: int = PAGE_ROWS, pivots: int = PIVOTS, levels: int = LEVELS, group_rows: int = GROUP_ROWS,
           block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` rows with the largest inner product of floor(scale * x).

    Exact. Rows with the query's own id are no candidates; ties go to the smaller id; a repeated id counts once, with its
    highest score. Vectors that are null or empty or hold null or non-finite components, and rows with a null id, take no
    part; a query is searched among vectors of its own length. Other columns are not read. An empty table gives an empty
    result. A component with abs(scale * x) >= 2^21 raises: its scores would not be exact.
    """
    spark = vectors.sparkSession
    data = write_table(integer_rows(vectors, id_col, vector_col, scale, LIMIT).withColumn("dim", F.size("x")), "topk_data")
    asked = write_table(integer_rows(queries, id_col, vector_col, scale, LIMIT).filter("id IS NOT NULL").select("id", "x", F.size("x").alias("dim")).distinct(), "topk_asked")
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]  # a row for each length
    found = None
    for dim in dims:
        part = _of_one_length(data.filter(F.col("dim") == dim).select("id", "x"), asked.filter(F.col("dim") == dim).select("id", "x"),
                              k + 1, page_rows, pivots, levels, group_rows, block_groups)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    # Each distinct vector has its k + 1 best; a query with that vector takes those that are not its own.
    best = found.groupBy("x", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("no", F.row_number().over(W.partitionBy("x").orderBy(F.desc("score"), "id"))).filter(F.col("no") <= k + 1)
    best = best.groupBy("x").agg(F.collect_list(F.struct("id", "score")).alias("best"))
    copies = asked.groupBy("x").agg(F.count("*").alias("copies"))
    rows = hot_join(asked.select("x", F.col("id").alias("query_id")), best.join(copies, "x"), ["x"], "copies", asked.count())
    rows = rows.select("query_id", F.explode("best").alias("b")).select("query_id", "b.*").filter("id <> query_id")
    rows = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _of_one_length(data: DataFrame, asked: DataFrame, k: int, page_rows: int, pivots: int, levels: int, group_rows: int, block_groups: int) -> DataFrame:
    """(x, id, score): candidates of each distinct query vector, the ``k`` best among them."""
    spark = data.sparkSession
    trees = write_table(_trees(_pages(_folded(data, asked, k), page_rows, pivots, levels), k), "topk_trees")
    groups = write_table(_groups(trees, group_rows), "topk_groups")
    blocks = max(1, -(-groups.count() // block_groups))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        # About block_groups * group_rows queries at a time are sent to all pages.
        sent = spark.sparkContext.broadcast([r["queries"] for r in groups.filter(F.col("block") == b).select("queries").collect()])
        part = write_table(trees.select("tree").mapInArrow(_searcher(sent, k), "x array<int>, id long, score long"), "topk_found")
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(sent, k: int):
    """Search all pages of a task for the groups of a block; the worst kth scores rise from page to page."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [CoverTree.load(g) for g in sent.value]
        best = [Best(len(g.x), k, g.worst) for g in groups]
        for batch in batches:
            for blob in batch.column(0):
                page = CoverTree.load(blob.as_py())
                for group, b in zip(groups, best, strict=True):
                    search_tree(group, page, b)
        for group, b in zip(groups, best, strict=True):
            if len(b.query):
                x = pa.array(group.x[b.query].astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([x, pa.array(b.id), pa.array(b.score.astype(np.int64))], ["x", "id", "score"])

    return look
