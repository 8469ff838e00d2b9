"""Pages of neighbouring vectors and the pairs of pages that can hold a similar pair.

Vectors are dealt to cells around pivots by angle; cells that are larger than a
page are split by pivots of their own, level by level. A cell's radius is the
largest angle from its pivot to a vector in it. Two cells whose pivots stand
further apart than both radii and the angle of the threshold hold no similar
pair (triangle inequality), nor do the cells within them: pairs of cells are
followed from the root down by joins of each level's cells, and only vectors
that may have a partner on the other page are sent to a pair of pages.

``Pages.meetings`` brings pages together without sending copies of them: a page
is written once, as a row, and a cartesian product of the written rows lets each
task read two runs of pages. What is written and shuffled grows with the
vectors, whatever number of pairs of pages there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, store

PIVOTS = 64             # cells that a cell is split into, at most
SAMPLE = 8              # vectors of a cell that are looked at for each of its pivots
LEVELS = 8              # splits; what no pivots part is then dealt by hash
TRIED = 2048            # vectors on which cells are tried where there are few pages
CHUNK_ROWS = 1 << 14    # vectors that a task compares with the pivots of their cell
RUN_BYTES = 1 << 26     # a task holds about so much of one side's pages and reads those of the other one by one
NULL_ID = np.iinfo(np.int64).max  # a null id on a written page; it equals no id, nor itself
SLACK = 1e-6            # radians; angles only bound, similar pairs are decided by the cosine itself


def reach(threshold: float, decimals: int) -> float:
    """The largest angle of a pair whose rounded cosine reaches the threshold."""
    if threshold <= 0:
        return math.pi  # zero vectors have no angle: nothing can be pruned
    return math.acos(max(-1.0, min(1.0, threshold - 10.0 ** -decimals))) + SLACK


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _far_apart(sample: pa.Table) -> pa.Table:
    """Pivots of a cell: of a sample's vectors always that which stands furthest from all picked before."""
    sample = sample.sort_by([("no", "ascending")])
    unit = _unit(_matrix(sample.column("vec")))
    cos, picked = unit @ unit[0], [0]
    while len(picked) < min(sample.column("wanted")[0].as_py(), len(unit)) and cos.min() < 1 - 1e-12:
        picked.append(int(cos.argmin()))
        cos = np.maximum(cos, unit @ unit[picked[-1]])
    out = sample.take(picked).drop_columns(["wanted"])
    return out.set_column(out.schema.get_field_index("no"), "no", pa.array(range(len(picked)), pa.int32()))


def _to_nearest(key: tuple[pa.Scalar, ...], rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Rows of a cell with their nearest pivot's number added to the path, and the angle to it."""
    rows = rows.drop_columns(["chunk"])
    if not len(rows):
        return rows
    pivots = pivots.sort_by([("no", "ascending")])
    cos = _unit(_matrix(rows.column("vec"))) @ _unit(_matrix(pivots.column("vec"))).T
    near = cos.argmax(1)
    path = pa.array([f"{key[0].as_py()}{i:02x}" for i in near], pa.string())
    far = pa.array(np.arccos(np.clip(cos[np.arange(len(cos)), near], -1, 1)))
    new = {"path": path, "far": far}
    return pa.table({n: new.get(n, rows.column(n)) for n in rows.column_names})


def split_pages(vectors: DataFrame, roots: DataFrame, page_rows: int, pivots: int = PIVOTS, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """``vectors`` (id, vec, path and others) with the path down to a page, far (angle to its pivot) and part; and each level's cells.

    ``roots`` (path, n; a written table): the cells to begin with, one, or one for each group of vectors that is dealt apart.
    Cells: parent, path, centre, radius, n. A cell that is a page already is its own and only child on the levels below.
    """
    rows = vectors.withColumn("far", F.lit(0.0))
    split = roots.filter(F.col("n") > page_rows).select("path", "n")
    table, done, moved = [], None, rows
    if not split.isEmpty():
        small = roots.filter(F.col("n") <= page_rows).select("path", "n")
        done = rows.join(small.select("path"), "path", "left_semi")
        moved = rows.join(split.select("path"), "path", "left_semi")
        none = F.lit(None).cast(vectors.schema["vec"].dataType)
        small = small.select(F.col("path").alias("parent"), "path", none.alias("centre"), F.lit(math.pi).alias("radius"), "n")
    else:
        levels = 0
    for _ in range(levels):
        split = split.withColumn("wanted", F.least(F.lit(pivots), F.ceil(F.col("n") * 2 / page_rows)).cast("int"))
        big = moved.join(split, "path")
        h = F.pmod(F.xxhash64("id", "path"), F.lit(1 << 40))
        near = big.withColumn("h", h).filter(F.col("h") < (F.col("wanted") * 2.0 * SAMPLE + 64) / F.col("n") * (1 << 40))
        no = F.row_number().over(Window.partitionBy("path").orderBy("h", "id"))
        sample = near.withColumn("no", no).filter(F.col("no") <= F.col("wanted") * SAMPLE).select("path", "no", "vec", "n", "wanted")
        picked = store(sample.groupBy("path").applyInArrow(_far_apart, sample.drop("wanted").schema), "cell_pivots")
        chunks = F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.lit(1)).cast("int")
        to = picked.select("path", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "no", "vec")
        part = big.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), chunks).cast("int")).select("chunk", *moved.columns)
        moved = store(part.groupBy("path", "chunk").cogroup(to.groupBy("path", "chunk")).applyInArrow(_to_nearest, moved.schema), "cell_rows")
        of = F.concat("path", F.lpad(F.lower(F.hex("no")), 2, "0"))
        sizes = moved.groupBy("path").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        cells = store(sizes.join(picked.select(F.col("path").alias("parent"), of.alias("path"), F.col("vec").alias("centre")), "path"), "cells")
        before = table[-1] if table else None
        here = cells.select("parent", "path", "centre", "radius", "n")
        pages = small if before is None else before.filter(F.col("n") <= page_rows).withColumn("parent", F.col("path"))
        here = here.unionByName(pages)
        table.append(here)
        split = cells.filter(F.col("n") > page_rows).select("path", "n")
        if split.isEmpty():
            break
        pages = moved.join(split, "path", "left_anti")
        done = pages if done is None else done.unionByName(pages)
        moved = moved.join(split.select("path"), "path", "left_semi")
    rows = moved if done is None else done.unionByName(moved)
    if table:
        parts = table[-1].select("path", F.ceil(F.col("n") / page_rows).cast("int").alias("parts"))
        deal = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
        rows = rows.join(parts, "path").withColumn("part", deal).drop("parts")
    else:
        rows = rows.withColumn("part", F.lit(0))
    return rows, table


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_pages(table: list[DataFrame], roots: DataFrame, page_rows: int, angle: float) -> DataFrame:
    """(a, pa, ra, b, pb, rb, apart): pairs of pages, each once, of one root that may hold a pair within ``angle``."""
    pairs = roots.select(F.col("path").alias("a"), F.col("path").alias("b"), F.ceil(F.col("n") / page_rows).cast("int").alias("parts"))
    flat = lambda c: F.transform(c, lambda x: x.cast("double"))
    for cells in table:
        v = flat("centre")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))
        cells = cells.select("parent", "path", unit.alias("c"), "radius", F.ceil(F.col("n") / page_rows).cast("int").alias("parts"))
        side = lambda s: cells.select(F.col("parent").alias(s), F.col("path").alias(s * 2), F.col("c").alias("c" + s),
                                      F.col("radius").alias("r" + s), F.col("parts").alias("n" + s))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("aa <= bb")
        cos = F.least(F.greatest(_dot("ca", "cb"), F.lit(-1.0)), F.lit(1.0))
        both = both.withColumn("apart", F.when(F.col("aa") == F.col("bb"), 0.0).otherwise(F.acos(cos)))
        near = both.filter(F.col("apart") <= F.col("ra") + F.col("rb") + angle + SLACK)
        pairs = store(near.select(F.col("aa").alias("a"), "ra", "na", F.col("bb").alias("b"), "rb", "nb", "apart"), "cell_pairs")
    if not table:
        pairs = pairs.select("a", F.lit(math.pi).alias("ra"), F.col("parts").alias("na"), "b", F.lit(math.pi).alias("rb"), F.col("parts").alias("nb"), F.lit(0.0).alias("apart"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every_part = pairs.withColumn("pa", every("na")).withColumn("pb", every("nb")).filter("a < b OR pa <= pb")
    return every_part.select("a", "pa", "ra", "b", "pb", "rb", "apart")


class Page:
    """The vectors of a written page, ordered by id."""

    def __init__(self, key: str, ids: bytes, far: bytes, vec: bytes, flag: bytes, centre: np.ndarray | None, radius: float):
        self.key, self.centre, self.radius = key, centre, radius
        self.id, self.far = np.frombuffer(ids, np.int64), np.frombuffer(far)
        self.vec = np.frombuffer(vec).reshape(len(self.id), -1)
        self.norm = np.linalg.norm(self.vec, axis=1)
        self.flag = np.frombuffer(flag, bool)

    def rows_near(self, other: Page, angle: float) -> np.ndarray:
        """The rows that may have a partner within ``angle`` on the other page."""
        if self.centre is None or other.centre is None:
            return np.arange(len(self.id))
        same = self.key.rpartition("/")[0] == other.key.rpartition("/")[0]
        apart = 0.0 if same else math.acos(max(-1.0, min(1.0, float(self.centre @ other.centre))))
        return np.flatnonzero(apart - self.far <= other.radius + angle + SLACK)


PAGE = ["key", "ids", "far", "vec", "flag", "centre", "radius"]


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The row of a page."""
    rows = rows.sort_by([("id", "ascending")])
    flag = rows.column("flag").to_numpy().astype(bool) if "flag" in rows.column_names else np.zeros(0, bool)
    blobs = [rows.column("id").fill_null(NULL_ID).to_numpy().astype(np.int64), rows.column("far").to_numpy().astype(float), _matrix(rows.column("vec")), flag]
    return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()),
                     **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("ids", "far", "vec", "flag"), blobs, strict=True)}})


def met_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Page, Page]]:
    """The pairs of pages of a task's ``meetings``; a page met with itself comes as one object."""
    left = None
    for batch in batches:
        for row in range(batch.num_rows):
            names = [[f"{side}_{c}" for c in PAGE] for side in "ab"]
            keys = [batch.column(n[0])[row].as_py() for n in names]
            pair = []
            for k, cols in zip(keys, names, strict=True):
                if left is not None and left.key == k:
                    pair.append(left)
                    continue
                blobs = [batch.column(c)[row].as_buffer() for c in cols[1:5]]
                centre = batch.column(cols[5])[row].values
                pair.append(Page(k, *blobs, None if centre is None else centre.to_numpy(zero_copy_only=False), batch.column(cols[6])[row].as_py()))
                left = pair[0]
            yield pair[0], pair[1]


@dataclass
class Pages:
    """Vectors (id, vec, path, part, far) dealt to pages of the cells of ``table``, to be met within ``angle``."""

    rows: DataFrame
    table: list[DataFrame]
    roots: DataFrame
    page_rows: int
    angle: float

    @cached_property
    def pairs(self) -> DataFrame:
        """The pairs of pages that may hold a pair within ``angle``."""
        return near_pages(self.table, self.roots, self.page_rows, self.angle)

    def blocks(self, flags: DataFrame | None = None) -> DataFrame:
        """(a, b, side, id, vec, flags): every pair of pages with the vectors of both that may be in a similar pair.

        With ``flags`` (id and others) only vectors that have a row there take part. A vector is copied for each page it may
        meet: for few pages; ``meetings`` copies none.
        """
        rows = self.rows if flags is None else self.rows.join(flags, "id")
        extra = [] if flags is None else [c for c in flags.columns if c != "id"]
        names = [F.concat_ws("/", p, c).alias(p) for p, c in (("a", "pa"), ("b", "pb"))]

        def side(mine: str, other: str, no: int) -> DataFrame:
            at = rows.withColumnsRenamed({"path": mine, "part": "p" + mine})
            joined = at.join(self.pairs, [mine, "p" + mine]).filter(F.col("apart") - F.col("far") <= F.col("r" + other) + self.angle + SLACK)
            return joined.select(*names, F.lit(no).alias("side"), "id", "vec", *extra)

        return side("a", "b", 0).unionByName(side("b", "a", 1))

    def meetings(self, flags: DataFrame | None = None, flag_col: str = "flag") -> DataFrame:
        """A row for each pair of pages that may hold a pair within ``angle``, for ``met_pages``.

        With ``flags`` (id and a boolean) only vectors that have a row there take part. Pages are written uncompressed, so
        that a run of pages (``spark.sql.files.maxPartitionBytes`` at most) is as large in memory.
        """
        spark = self.rows.sparkSession
        rows = self.rows.select("id", "vec", "far", "path", "part")
        if flags is not None:
            rows = rows.join(flags.select("id", F.col(flag_col).alias("flag")), "id")
        pages = rows.groupBy("path", "part").applyInArrow(_packed, "path string, part int, ids binary, far binary, vec binary, flag binary")
        if self.table:
            norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
            cells = self.table[-1].withColumn("centre", F.transform("centre", lambda x: x.cast("double")))
            cells = cells.select("path", F.transform("centre", lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("centre"), "radius")
            pages = pages.join(cells, "path")
        else:
            pages = pages.withColumns({"centre": F.lit(None).cast("array<double>"), "radius": F.lit(math.pi)})
        pages = pages.withColumn("key", F.concat_ws("/", "path", "part")).select(*PAGE, "path")
        path = scratch_path(spark, "pages")
        pages.write.option("compression", "uncompressed").parquet(path)
        pages = spark.read.schema(pages.schema).parquet(path)
        runs = -(-(pages.agg(F.sum(F.octet_length("vec"))).first()[0] or 0) // RUN_BYTES)
        a, b = (pages.withColumnsRenamed({c: f"{side}_{c}" for c in pages.columns}) for side in "ab")
        cos = F.least(F.greatest(_dot("a_centre", "b_centre"), F.lit(-1.0)), F.lit(1.0))
        near = F.acos(cos) <= F.col("a_radius") + F.col("b_radius") + self.angle + SLACK
        may = F.col("a_centre").isNull() | F.col("b_centre").isNull() | (F.col("a_path") == F.col("b_path")) | near
        met = a.join(b.coalesce(max(runs, 1)).hint("shuffle_replicate_nl"), (F.col("a_key") <= F.col("b_key")) & may)
        return met.select(*[f"{side}_{c}" for side in "ab" for c in PAGE])


def _structured(vectors: DataFrame, n: int, page_rows: int, angle: float, pivots: int) -> bool:
    """Whether cells would part a sample of a table of few pages: weighted by size, at most half of their pairs are near."""
    got = vectors.select(F.xxhash64("id").alias("h"), "id", "vec").orderBy("h", "id").limit(TRIED).toArrow()
    unit = _unit(_matrix(got.column("vec")))
    cos, picked = unit @ unit[0], [0]
    while len(picked) < min(pivots, -(-2 * n // page_rows)):
        picked.append(int(cos.argmin()))
        cos = np.maximum(cos, unit @ unit[picked[-1]])
    to = np.arccos(np.clip(unit @ unit[picked].T, -1, 1))
    cell = to.argmin(1)
    size = np.bincount(cell, minlength=len(picked)) / len(unit)
    radius = np.zeros(len(picked))
    np.maximum.at(radius, cell, to.min(1))
    near = to[picked] <= radius[:, None] + radius[None, :] + angle
    return float(size @ near @ size) <= 0.5


def deal_pages(vectors: DataFrame, threshold: float, decimals: int, page_rows: int, pivots: int = PIVOTS) -> Pages:
    """Pages of ``vectors`` (id, vec), which should be written already: they are counted first.

    A table of few pages whose cells would nearly all be near each other is dealt to pages by hash: cells cost more there
    than they save. Results are the same.
    """
    n, angle = vectors.count(), reach(threshold, decimals)
    roots = vectors.sparkSession.createDataFrame([("", n)], "path string, n long")
    rows, table = vectors.withColumn("path", F.lit("")), []
    if n <= page_rows or threshold <= 0 or 2 * n <= pivots * page_rows and not _structured(vectors, n, page_rows, angle, pivots):
        part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(max(1, -(-n // page_rows)))).cast("int")
        rows = rows.withColumns({"far": F.lit(0.0), "part": part})
    else:
        rows, table = split_pages(rows, roots, page_rows, pivots)
    return Pages(rows, table, roots, page_rows, angle)
