"""Spans of neighbouring vectors, met pair by pair in single precision.

Vectors are dealt to spans of some thousand rows by a tree of cuts along the
axes on which a sample of them varies most; the tree only decides which rows
stand together, never what is found. A span is one written row. Within it rows
are ordered in chunks, again by cuts, and each row has its place: its
coordinates on the axes and the length of the rest. Places never stand further
apart than the vectors do, so a row whose place is further from a chunk's box
than the threshold's distance has no partner in the chunk.

Spans meet in a cartesian product of the written rows. Products of unit vectors
are taken in single precision, whose error is bounded; whatever that leaves
open is decided by the cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .cells import NULL_ID, _matrix, _unit
from .joins import merge_labels

SPAN_ROWS = 1 << 14    # vectors of a span, about
SPAN_BYTES = 1 << 23
CHUNK_ROWS = 1 << 10   # rows of a box
BLOCK_ROWS = 1 << 11   # rows of a product
AXES = 16
SAMPLE_ROWS = 1 << 16  # vectors from which axes and cuts are taken
SAMPLE_BYTES = 1 << 25
RUN_BYTES = 1 << 26    # a task reads about so much of one side's spans again for each span of the other
SLACK = 1e-5           # places are stored in single precision
VERIFY_ROWS = 1 << 16  # pairs whose cosines are taken at once


@dataclass
class Layout:
    """Axes and the tree of cuts. A node with ``dim`` -1 is a leaf: ``left`` its first span, ``right`` its number of spans."""

    mean: np.ndarray
    axes: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        off = np.nan_to_num(_unit(x), posinf=0.0, neginf=0.0) - self.mean
        on = off @ self.axes
        rest = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", off, off) - np.einsum("ij,ij->i", on, on)))
        return np.column_stack((on, rest)).astype(np.float32)

    def leaves(self, place: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(place), np.int64), np.arange(len(place))
        while (inner := self.dim[at] >= 0).any():
            up = place[every, self.dim[at]] >= self.cut[at]
            at = np.where(inner, np.where(up, self.right[at], self.left[at]), at)
        return at


def _layout(sample: np.ndarray, n: int, span_rows: int, like: Layout | None) -> Layout:
    if like is not None:
        mean, axes = like.mean, like.axes
    elif len(sample):
        unit = np.nan_to_num(_unit(sample), posinf=0.0, neginf=0.0)
        mean = unit.mean(0)
        axes = np.linalg.svd(unit[:2048] - mean, full_matrices=False)[2][:AXES].T
    else:
        mean, axes = np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 1))
    tree = Layout(mean, axes, *(np.zeros(0) for _ in range(4)))
    place, nodes, spans = tree.places(sample), [[-1, 0.0, 0, 1]], 0
    open_ = [(0, np.arange(len(place)))]
    while open_:
        node, rows = open_.pop()
        size, z = len(rows) * n / max(len(place), 1), place[rows]
        low = None
        if size > span_rows and len(rows) > 1:
            dim = int(z.var(0).argmax())
            cut = np.median(z[:, dim])
            low = z[:, dim] < cut
            if not low.any():  # the median is the least value
                above = z[:, dim][z[:, dim] > cut]
                cut = above.min() if len(above) else cut
                low = z[:, dim] < cut
        if low is not None and low.any():
            nodes[node] = [dim, float(cut), len(nodes), len(nodes) + 1]
            open_ += [(len(nodes), rows[low]), (len(nodes) + 1, rows[~low])]
            nodes += [[-1, 0.0, 0, 1], [-1, 0.0, 0, 1]]
        else:  # equal vectors are dealt in turn
            parts = max(1, math.ceil(size / span_rows))
            nodes[node], spans = [-1, 0.0, spans, parts], spans + parts
    dim, cut, left, right = zip(*nodes, strict=True)
    return Layout(mean, axes, np.array(dim), np.array(cut, np.float32), np.array(left), np.array(right))


def _ordered(place: np.ndarray) -> np.ndarray:
    """Rows in the order of chunks of neighbours; all chunks but the last have CHUNK_ROWS."""
    out, open_ = [], [np.arange(len(place))]
    while open_:
        rows = open_.pop()
        if len(rows) <= CHUNK_ROWS:
            out.append(rows)
            continue
        half = -(-len(rows) // CHUNK_ROWS) // 2 * CHUNK_ROWS
        by = np.argpartition(place[rows, int(place[rows].var(0).argmax())], half)
        open_ += [rows[by[half:]], rows[by[:half]]]
    return np.concatenate(out)


class Span:
    """A written span's rows; ``mark`` and ``label`` as the function gave them that dealt the vectors."""

    def __init__(self, no: int, ids: np.ndarray, vec: np.ndarray, place: np.ndarray, mark: np.ndarray, label: np.ndarray):
        self.no, self.id, self.vec, self.place, self.mark, self.label = no, ids, vec, place, mark, label
        self.norm = np.linalg.norm(vec, axis=1)
        self.unit = (vec / np.where(self.norm == 0, 1, self.norm)[:, None]).astype(np.float32)
        self.starts = np.arange(0, len(ids), CHUNK_ROWS)
        self.low, self.high = np.minimum.reduceat(place, self.starts), np.maximum.reduceat(place, self.starts)


SPAN = ["no", "ids", "vec", "place", "mark", "label"]
BOX = ["low", "high"]


@dataclass(frozen=True)
class Limit:
    """What single precision and places say of a threshold on cosines rounded to ``decimals``."""

    threshold: float
    decimals: int

    def error(self, dim: int) -> float:
        return (dim + 16) * 2.0 ** -23

    def least(self, dim: int) -> float:
        """A product below it belongs to no pair."""
        return self.threshold - 10.0 ** -self.decimals - self.error(dim)

    def sure(self, dim: int) -> float:
        """A product from it on belongs to a pair."""
        return self.threshold + 10.0 ** -self.decimals + self.error(dim)

    def reach(self) -> float:
        """The square of the distance from which on places belong to no pair."""
        return _reach(np.array([self.threshold - 10.0 ** -self.decimals]))[0] if self.threshold > 0 else math.inf


def _reach(cosine: np.ndarray) -> np.ndarray:
    return np.where(cosine > 0, (np.sqrt(2 * np.maximum(0.0, 1 - cosine)) + SLACK) ** 2, np.inf)


def _apart(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(0, np.maximum(low - place, place - high))
    return np.einsum("ij,ij->i", gap, gap)


def cosines(a: Span, r: np.ndarray, b: Span, c: np.ndarray, decimals: int) -> np.ndarray:
    out = np.empty(len(r))
    for k in range(0, len(r), VERIFY_ROWS):
        i, j = r[k:k + VERIFY_ROWS], c[k:k + VERIFY_ROWS]
        scale = a.norm[i] * b.norm[j]
        out[k:k + VERIFY_ROWS] = np.round(np.einsum("ij,ij->i", a.vec[i], b.vec[j]) / np.where(scale == 0, 1e-12, scale), decimals)
    return out


def products(a: Span, rows: np.ndarray, b: Span, cols: np.ndarray, reach: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, products) of blocks of ``rows`` and ``cols`` that may hold pairs within ``reach`` (one, or one for each of ``rows``)."""
    if not len(rows) or not len(cols):
        return
    near = _apart(a.place[rows], b.place[cols].min(0), b.place[cols].max(0)) <= reach
    rows, reach = rows[near], reach if np.isscalar(reach) else reach[near]
    if not len(rows):
        return
    widest = reach if np.isscalar(reach) else reach.max()
    cols = cols[_apart(b.place[cols], a.place[rows].min(0), a.place[rows].max(0)) <= widest]
    for k, at in enumerate(b.starts):
        some = cols[np.searchsorted(cols, at):np.searchsorted(cols, at + CHUNK_ROWS)]
        if not len(some):
            continue
        mine = rows[_apart(a.place[rows], b.low[k], b.high[k]) <= reach]
        right = np.ascontiguousarray(b.unit[some].T)
        for i in range(0, len(mine), BLOCK_ROWS):
            part = mine[i:i + BLOCK_ROWS]
            yield part, some, a.unit[part] @ right


def _enough(r: np.ndarray, sure: np.ndarray, need: int) -> np.ndarray:
    """Which of some rows' hits to keep: ``need`` sure ones of a row that has so many, all of the others."""
    known = np.flatnonzero(sure)
    known = known[np.argsort(r[known], kind="stable")]
    of = r[known]
    turn = np.arange(len(of)) - np.searchsorted(of, of)
    full = np.unique(of[turn >= need - 1])
    keep = ~np.isin(r, full)
    keep[known[(turn < need) & np.isin(of, full)]] = True
    return keep


def near_rows(a: Span, rows: np.ndarray, b: Span, cols: np.ndarray, limit: Limit, bound: np.ndarray | None = None,
              need: int | None = None, both: np.ndarray | None = None):
    """(row of a, row of b, rounded cosine) of all pairs at or above the threshold and the bound of their row of ``rows`` (a product).

    With ``need`` a row of ``rows``, and one of b where ``both`` is true, that has more partners than that is given some of them,
    ``need`` at least.
    """
    dim = a.vec.shape[1]
    least, sure, reach = limit.least(dim), limit.sure(dim), limit.reach()
    of = None
    if bound is not None:  # bounds hold for products: the cosine may be less by their error
        of = np.full(len(a.id), np.inf, np.float32)
        of[rows] = np.maximum(bound, least)
        reach = np.minimum(reach, _reach(of[rows].astype(float) - limit.error(dim)))
    found = []
    for mine, some, cos in products(a, rows, b, cols, reach):
        at = np.flatnonzero(cos >= (least if of is None else of[mine][:, None]))
        if len(at):
            i, j = np.divmod(at, len(some))
            r, c = mine[i], some[j]
            apart = (a.id[r] != b.id[c]) | (a.id[r] == NULL_ID)
            if need is not None and len(at) > need:
                r, c, known = r[apart], c[apart], cos.ravel()[at[apart]] >= sure
                apart = _enough(r, known, need)
                if both is not None:
                    two = np.flatnonzero(both[c])
                    apart[two] |= _enough(c[two], known[two], need)
            found.append((r[apart], c[apart]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, c = (np.concatenate(x) for x in zip(*found, strict=True))
    s = cosines(a, r, b, c, limit.decimals)
    keep = s >= limit.threshold
    return r[keep], c[keep], s[keep]


class Merged:
    """Labels that links have joined, and those links: one fewer than the labels of each group that they join."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def of(self, labels: np.ndarray) -> np.ndarray:
        some, at = np.unique(labels, return_inverse=True)
        return np.array([self.find(x) for x in some.tolist()], np.int64)[at] if len(some) else labels

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.column_stack((a, b)), axis=0).tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.above[max(x, y)] = min(x, y)
                self.links.append((x, y))


def join_rows(a: Span, rows: np.ndarray, b: Span, cols: np.ndarray, limit: Limit, merged: Merged) -> None:
    """Join the labels of all pairs of ``rows`` and ``cols`` at or above the threshold."""
    dim = a.vec.shape[1]
    least, sure = limit.least(dim), limit.sure(dim)
    of_a, of_b = a.label.copy(), b.label.copy()
    of_a[rows], of_b[cols] = merged.of(a.label[rows]), merged.of(b.label[cols])
    for mine, some, cos in products(a, rows, b, cols, limit.reach()):
        hit = cos >= least
        if not hit.any():
            continue
        hit &= of_a[mine][:, None] != of_b[some][None, :]
        known = hit & (cos >= sure)
        while True:  # a link of each row, until its group is joined with all that it is linked to
            i = np.flatnonzero(known.any(axis=1))
            if len(i):
                r, c = mine[i], some[known[i].argmax(axis=1)]
            else:
                i, j = np.nonzero(hit)
                s = cosines(a, mine[i], b, some[j], limit.decimals) >= limit.threshold
                r, c = mine[i[s]], some[j[s]]
            if not len(r):
                break
            merged.join(of_a[r], of_b[c])
            of_a[rows], of_b[cols] = merged.of(of_a[rows]), merged.of(of_b[cols])
            hit &= of_a[mine][:, None] != of_b[some][None, :]
            known &= hit


Marks = Callable[[Span], tuple[np.ndarray, np.ndarray]]


def _no_marks(span: Span) -> tuple[np.ndarray, np.ndarray]:
    return span.mark, span.label


def span_layout(vectors: DataFrame, span_rows: int = SPAN_ROWS, like: Layout | None = None) -> Layout:
    """How to deal ``vectors`` (id, vec; a written table). Places of two tables that are to meet need the axes of one layout: ``like``."""
    n = vectors.count()
    first = vectors.select(F.size("vec").alias("d")).first()
    dim = max(first["d"], 1) if first and first["d"] else 1
    want = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    got = vectors.select("vec").sample(min(1.0, want / max(n, 1)), seed=7).toArrow().column("vec")
    if not len(got):
        got = vectors.select("vec").limit(want).toArrow().column("vec")
    # Few vectors make smaller spans, so that there are pairs enough for all tasks.
    rows = max(1, min(span_rows, SPAN_BYTES // (8 * dim), max(CHUNK_ROWS, -(-n // 32))))
    return _layout(_matrix(got) if len(got) else np.zeros((0, dim)), n, rows, like)


def deal_spans(vectors: DataFrame, tree: Layout, marks: Marks = _no_marks) -> DataFrame:
    """The written spans of ``vectors`` (id, vec, and label where there is one).

    ``marks`` gives each row of a span its mark (a float) and its label (a long), from what the span alone shows.
    """
    spark = vectors.sparkSession
    labelled = "label" in vectors.columns

    def to_span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(tree.dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = tree.leaves(tree.places(_matrix(pa.chunked_array([batch.column("vec")]))))
            by = np.argsort(leaf, kind="stable")
            which, begin, size = np.unique(leaf[by], return_index=True, return_counts=True)
            turn = np.empty(len(leaf), np.int64)
            turn[by] = np.arange(len(leaf)) - np.repeat(begin, size) + np.repeat(seen[which], size)
            seen[which] += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.left[leaf] + turn % tree.right[leaf])], [*batch.schema.names, "no"])

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("vec"))
        place = tree.places(x)
        by = _ordered(place)
        ids = rows.column("id").fill_null(NULL_ID).to_numpy().astype(np.int64)[by]
        label = rows.column("label").to_numpy().astype(np.int64)[by] if labelled else ids
        span = Span(key[0].as_py(), ids, x[by], place[by], np.zeros(len(ids)), label)
        mark, label = marks(span)
        blobs = (span.id, span.vec, span.place, mark.astype(float), label.astype(np.int64))
        box = [pa.array([list(map(float, f(span.place)))], pa.list_(pa.float64())) for f in (lambda p: p.min(0), lambda p: p.max(0))]
        return pa.table({"no": pa.array([span.no], pa.int64()), **dict(zip(BOX, box, strict=True)),
                         **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in zip(SPAN[1:], blobs, strict=True)}})

    cols = ["id", F.col("vec").cast("array<double>").alias("vec"), *(["label"] if labelled else [])]
    dealt = vectors.select(*cols).mapInArrow(to_span, "id long, vec array<double>, " + ("label long, " if labelled else "") + "no long")
    schema = "no long, low array<double>, high array<double>, ids binary, vec binary, place binary, mark binary, label binary"
    path = scratch_path(spark, "spans")
    # A span is a row of some MB: the writer looks after each one how much it holds.
    packed = dealt.groupBy("no").applyInArrow(pack, schema)
    packed.write.options(**{"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(RUN_BYTES)}).parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def meet_spans(spans: DataFrame, limit: Limit, others: DataFrame | None = None) -> DataFrame:
    """A row for each pair of spans, of one table or of two (on the same axes), whose boxes leave room for a pair, for ``met_spans``."""
    spark = spans.sparkSession
    sides = [spans, spans if others is None else others]
    size = F.sum(F.octet_length("vec") + F.octet_length("place"))
    runs = [max(1, -(-(s.agg(size).first()[0] or 0) // RUN_BYTES)) for s in sides[:1 if others is None else 2]]
    a, b = (s.withColumnsRenamed({c: f"{side}_{c}" for c in s.columns}) for side, s in zip("ab", sides, strict=True))
    a = a.coalesce(max(runs[0], 2 * spark.sparkContext.defaultParallelism))
    gap = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
                     lambda x, y: F.greatest(x, y, F.lit(0.0)))
    when = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= F.lit(float(limit.reach()))
    if others is None:  # each pair once, as many from either side
        odd = (F.col("a_no") + F.col("b_no")) % 2 == 1
        when = (F.when(F.col("a_no") < F.col("b_no"), ~odd).when(F.col("a_no") > F.col("b_no"), odd).otherwise(F.lit(True))) & when
    met = a.join(b.coalesce(runs[-1]).hint("shuffle_replicate_nl"), when)
    return met.select(*[f"{side}_{c}" for side in "ab" for c in SPAN])


def read_span(batch: pa.RecordBatch, row: int, side: str = "") -> Span:
    no, ids, vec, place, mark, label = (batch.column(f"{side}{c}")[row] for c in SPAN)
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    shaped = lambda x, kind: np.frombuffer(x.as_buffer(), kind).reshape(len(ids), -1)
    return Span(no.as_py(), ids, shaped(vec, float), shaped(place, np.float32), np.frombuffer(mark.as_buffer()), np.frombuffer(label.as_buffer(), np.int64))


def met_spans(batches: Iterator[pa.RecordBatch], one_table: bool = True) -> Iterator[tuple[Span, Span]]:
    """The pairs of spans of a task's ``meet_spans``; a span met with itself comes as one object."""
    left = None
    for batch in batches:
        for row in range(batch.num_rows):
            if left is None or left.no != batch.column("a_no")[row].as_py():
                left = read_span(batch, row, "a_")
            yield left, left if one_table and left.no == batch.column("b_no")[row].as_py() else read_span(batch, row, "b_")


DEAD, OPEN, CORE = 0.0, 1.0, 2.0  # marks: of a null id, so no part of a cluster; with too few neighbours in its own span; a core


def core_marks(limit: Limit, need: int) -> Marks:
    """Which rows have ``need`` neighbours in their own span, and the smallest id of what links between such rows join there."""

    def marks(span: Span) -> tuple[np.ndarray, np.ndarray]:
        m, sure = len(span.id), limit.sure(span.vec.shape[1])
        blocks = [np.arange(k, min(k + BLOCK_ROWS, m)) for k in range(0, m, BLOCK_ROWS)]
        twice = len(np.unique(span.id)) < m
        count = np.zeros(m, np.int64)
        for k, block in enumerate(blocks):
            rows = block
            for other in (block, *blocks[:k], *blocks[k + 1:]):
                hit = span.unit[rows] @ span.unit[other].T >= sure
                if twice:
                    hit &= span.id[rows][:, None] != span.id[other][None, :]
                elif other is block:
                    np.fill_diagonal(hit, False)
                count[rows] += np.count_nonzero(hit, axis=1)
                rows = rows[count[rows] < need]
                if not len(rows):
                    break
        mark = np.where(span.id == NULL_ID, DEAD, np.where(count >= need, CORE, OPEN))
        group = np.arange(m)
        cores = [b[mark[b] == CORE] for b in blocks]
        for k, rows in enumerate(cores):
            for cols in cores[:k + 1]:
                both = np.concatenate((group[rows], group[cols]))
                if not len(both) or (both == both[0]).all():
                    continue
                hit = span.unit[rows] @ span.unit[cols].T >= sure
                while True:
                    hit &= group[rows][:, None] != group[cols][None, :]
                    i = np.flatnonzero(hit.any(axis=1))
                    if not len(i):
                        break
                    group = merge_labels(group, rows[i], cols[hit[i].argmax(axis=1)])
        low = np.full(m, NULL_ID)
        core = mark == CORE
        np.minimum.at(low, group[core], span.id[core])
        return mark, np.where(core, low[group], span.id)

    return marks


def best_marks(limit: Limit, most: int) -> Marks:
    """The least product that a partner must reach to be among a row's best ``most``, as far as the rows around it show."""

    def marks(span: Span) -> tuple[np.ndarray, np.ndarray]:
        m, dim = len(span.id), span.vec.shape[1]
        mark = np.full(m, limit.least(dim))
        twice = len(np.unique(span.id)) < m
        for k in range(0, m, BLOCK_ROWS):
            rows = np.arange(k, min(k + BLOCK_ROWS, m))
            if len(rows) <= most:
                continue
            cos = span.unit[rows] @ span.unit[rows].T
            if twice:
                cos[span.id[rows][:, None] == span.id[rows][None, :]] = -2
            np.fill_diagonal(cos, -2)
            kth = np.partition(np.nan_to_num(cos, nan=-2), len(rows) - most, axis=1)[:, len(rows) - most]
            # Equal after rounding counts as well, and either product may be off by its error.
            mark[rows] = np.maximum(mark[rows], kth - 2 * limit.error(dim) - 10.0 ** -limit.decimals)
        return mark, span.label

    return marks
