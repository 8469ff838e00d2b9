"""Vectors: tokens (I5), embeddings (I2) and exact similarity pairs.

The built-in encoder is native Spark: hashed term counts (md5 bucket of each
token), L2-normalised. A model encoder plugs in as a batch function through
``mapInPandas`` (Arrow batches; the function loads its model once per worker).

Similarity is exact. Vectors are dealt to pages around pivots (``cells.py``); pages whose pivots and radii
leave room for a similar pair meet in a task that reads both where they are written, so no vector is shuffled
once for each page it meets. A task multiplies two pages at a time. ``similarity_pairs`` emits the pairs at or
above the threshold; ``degrees`` and ``core_graph`` give a count per vector, a forest of core links and each border
vector's best core without a table of all pairs. What a task finds for one vector on many pages
(its count, its best partners) is one result of the task. With ``max_neighbours``, and for density clusters,
vectors meet in spans instead (``spans.py``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread, store
from .cells import NULL_ID, Page, Pages, deal_pages, met_pages
from .joins import star_forest
from .spans import Limit, Span, best_marks, deal_spans, meet_spans, met_spans, near_rows, span_layout

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokenise(df: DataFrame, text_col: str, keep=(), min_len: int = 2) -> DataFrame:
    """Lower-cased letter/digit runs of ``min_len``+ characters, one row per token occurrence."""
    toks = spread(df).select(*keep, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("term"))
    return toks.filter(F.length("term") >= min_len)


def token_bucket(term, dim: int) -> F.Column:
    """md5-based bucket of a token: first 8 hex digits as an integer, mod ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashed_weights(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """I2 (sparse form): (id, bucket, weight) with weights L2-normalised per id."""
    toks = tokenise(df, text_col, keep=(id_col,))
    counts = toks.groupBy(id_col, token_bucket(F.col("term"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # The norm window spans one id's buckets (at most ``dim`` rows) and reuses
    # the aggregate's partitioning by id: no second pass over the tokens.
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "bucket", (F.col("n") / norm).alias("weight"))


def embed(df: DataFrame, id_col: str = "article_id", text_col: str = "text_src", dim: int = 64,
          embed_fn: Callable[[list[str]], np.ndarray] | None = None, batch_size: int = 8,
          max_tokens: int = 512) -> DataFrame:
    """``(id, vec array<double>)``.

    Default: hashed term counts (dense ``dim`` array built from the sparse
    weights; texts without tokens get no row). With ``embed_fn`` a text is cut
    into windows of ``max_tokens`` whitespace tokens, all windows of an Arrow
    batch are encoded ``batch_size`` at a time, and a text's vector is the mean
    of its windows' vectors weighted by their tokens.
    """
    if embed_fn is None:
        w = hashed_weights(df, id_col, text_col, dim)
        m = w.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
        vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
        return m.select(id_col, vec.alias("vec"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            windows, owner, size = [], [], []
            for k, t in enumerate(pdf[text_col].tolist()):
                words = str(t or "").split()
                for i in range(0, max(len(words), 1), max_tokens):
                    windows.append(" ".join(words[i:i + max_tokens]))
                    owner.append(k)
                    size.append(max(len(words[i:i + max_tokens]), 1))
            vecs = [np.asarray(embed_fn(windows[i:i + batch_size]), dtype="float64") for i in range(0, len(windows), batch_size)]
            if not vecs:
                continue
            weight = np.array(size, dtype="float64")
            total = np.zeros((len(pdf), vecs[0].shape[1]))
            np.add.at(total, owner, np.vstack(vecs) * weight[:, None])
            mean = total / np.bincount(owner, weight, minlength=len(pdf))[:, None]
            yield pd.DataFrame({id_col: pdf[id_col], "vec": mean.tolist()})

    ensure_checkpoint_dir(df.sparkSession)
    return spread(df.select(id_col, text_col)).mapInPandas(run, f"{id_col} long, vec array<double>")


def pages_of(vectors: DataFrame, threshold: float, id_col: str = "article_id", vec_col: str = "vec",
             block_size: int = 2048, decimals: int = 6) -> Pages:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return deal_pages(v, threshold, decimals, block_size)


def _hits(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, decimals: int):
    """(rows of a, rows of b, rounded cosines) at or above the threshold."""
    scale = np.outer(na, nb)
    scale[scale == 0] = 1e-12
    sims = a @ b.T
    sims /= scale
    r, c = np.nonzero(sims >= threshold - 10.0 ** -decimals)  # rounding moves a cosine by half of that at most
    s = np.round(sims[r, c], decimals)
    keep = s >= threshold
    return r[keep], c[keep], s[keep]


def _met(batches: Iterator[pa.RecordBatch], threshold: float, decimals: int, angle: float):
    """(left page, right page, left rows, right rows, cosines) at or above the threshold, of every pair of pages of a task.

    A page met with itself gives each pair both ways.
    """
    for a, b in met_pages(batches):
        mine, other = a.rows_near(b, angle), b.rows_near(a, angle)
        r, c, s = _hits(a.vec[mine], b.vec[other], a.norm[mine], b.norm[other], threshold, decimals)
        r, c = mine[r], other[c]
        keep = (a.id[r] != b.id[c]) | (a.id[r] == NULL_ID)
        yield a, b, r[keep], c[keep], s[keep]


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, most: int):
    """The ``most`` partners j of each i with the highest cosines, ties to the smaller id."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[keep], j[keep], s[keep]


def _found(pdf: pd.DataFrame, threshold: float, decimals: int, most: int | None) -> pd.DataFrame:
    """(i, j, cosine) of two blocks of a band: each pair once, or with ``most`` the best partners of each vector, both ways."""
    apart = pdf["a"].iloc[0] != pdf["b"].iloc[0]
    left = pdf[pdf["side"] == 0].sort_values("id")
    right = pdf[pdf["side"] == 1].sort_values("id") if apart else left
    if left.empty or right.empty:
        return pd.DataFrame({"i": [], "j": [], "cosine": []})
    a, b = (np.vstack(x["vec"].to_numpy()).astype("float64") for x in (left, right))
    r, c, s = _hits(a, b, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), threshold, decimals)
    # A pair is found in the first band of which it shares the key.
    lk, rk, band = np.stack(left["keys"].to_list()), np.stack(right["keys"].to_list()), pdf["band"].iloc[0]
    i, j = left["id"].to_numpy()[r], right["id"].to_numpy()[c]
    keep = (i != j) & ((lk[r] == rk[c]).argmax(1) == band)
    i, j, s = i[keep], j[keep], s[keep]
    if most is None:
        keep = (i < j) | apart
        return pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "cosine": s[keep]})
    both = [_best(i, j, s, most), *([_best(j, i, s, most)] if apart else [])]
    return pd.DataFrame(dict(zip(("i", "j", "cosine"), (np.concatenate(x) for x in zip(*both, strict=True)), strict=True)))


OUT_ROWS = 1 << 20  # rows that are handed on at once


def _nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=x == NULL_ID) if x.dtype == np.int64 else pa.array(x)


def batches_of(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns as Arrow batches, NULL_ID as null."""
    n = len(next(iter(columns.values())))
    for k in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_pydict({name: _nullable(x[k:k + OUT_ROWS]) for name, x in columns.items()})


PAIRS = "i long, j long, cosine double"


def similarity_pairs(vectors: DataFrame, threshold: float, method: str = "blocked", max_neighbours: int | None = None,
                     id_col: str = "article_id", vec_col: str = "vec", block_size: int = 2048, decimals: int = 6,
                     checkpoint_input: bool = True, recall: float = 0.97) -> DataFrame:
    """Every pair ``i < j`` with cosine (rounded to ``decimals``) >= ``threshold``.

    ``blocked`` is exact. ``lsh`` looks at pairs that share a key of one of some bands of random hyperplanes (their number
    follows from ``recall``, the share of pairs at the threshold that should be found); what it finds is checked exactly.
    With ``max_neighbours`` only pairs are kept of which one is among the other's best (ties to the smaller id).
    """
    ensure_checkpoint_dir(vectors.sparkSession)  # also ships this package to the Python workers
    if checkpoint_input:  # counted, then read again: compute the vectors once
        vectors = store(vectors, "vectors")
    if method == "blocked" and max_neighbours is not None:
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        limit = Limit(threshold, decimals)
        spans = deal_spans(v, span_layout(v, 8 * block_size), best_marks(limit, max_neighbours))
        found = meet_spans(spans, limit).mapInArrow(_best_finder(limit, max_neighbours), PAIRS)
    elif method == "blocked":
        pages = pages_of(vectors, threshold, id_col, vec_col, block_size, decimals)
        found = pages.meetings().mapInArrow(_pair_finder(threshold, decimals, pages.angle, max_neighbours), PAIRS)
    elif method == "lsh":
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return _found(pdf, threshold, decimals, max_neighbours)

        found = _banded(v, threshold, block_size, recall).groupBy("band", "key", "a", "b").applyInPandas(run, PAIRS)
    else:
        raise ValueError(f"method is blocked or lsh, not {method}")
    if max_neighbours is None:
        return found
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cosine"), "j"))
    best = found.withColumn("no", rank).filter(F.col("no") <= max_neighbours)
    return best.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cosine").distinct()


def _best_finder(limit: Limit, most: int):
    """The best partners of each vector on a task's spans, both ways; only products that reach a row's mark are looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def add(a: Span, b: Span) -> None:
            r, c, s = near_rows(a, np.arange(len(a.id)), b, np.arange(len(b.id)), limit, a.mark)
            if len(r):
                old = held.get(a.no, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                held[a.no] = _best(*(np.concatenate(x) for x in zip(old, (a.id[r], b.id[c], s), strict=True)), most)

        for a, b in met_spans(batches):
            add(a, b)
            if a is not b:
                add(b, a)
        for i, j, s in held.values():
            yield from batches_of(i=i, j=j, cosine=s)

    return run


def _pair_finder(threshold: float, decimals: int, angle: float, most: int | None):
    """Pairs of a task's pages as they are found, or with ``most`` the best partners of each vector on all of them, both ways."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, r, c, s in _met(batches, threshold, decimals, angle):
            i, j = a.id[r], b.id[c]
            if a is b:
                once = (i < j) & (j < NULL_ID)
                i, j, s = i[once], j[once], s[once]
            known = (i < NULL_ID) & (j < NULL_ID)
            i, j = np.where(known, i, NULL_ID), np.where(known, j, NULL_ID)
            yield from batches_of(i=np.minimum(i, j), j=np.maximum(i, j), cosine=s)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}

        def add(page: Page, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
            old = held.get(page.key)
            held[page.key] = _best(*((i, j, s) if old is None else (np.concatenate(x) for x in zip(old, (i, j, s), strict=True))), most)

        for a, b, r, c, s in _met(batches, threshold, decimals, angle):
            add(a, a.id[r], b.id[c], s)
            if a is not b:
                add(b, b.id[c], a.id[r], s)
        for i, j, s in held.values():
            yield from batches_of(i=i, j=j, cosine=s)

    return pairs if most is None else best


def lsh_bands(threshold: float, spread: float, n: int, block_size: int, recall: float) -> tuple[int, int]:
    """(bits of a key, bands): keys long enough that most hold a block at most, bands enough for ``recall`` at the threshold.

    ``spread``: squared length of the vectors that the hyperplanes cut; the shorter, the wider the angle of a similar pair.
    """
    bits = max(6, math.ceil(math.log2(max(n / block_size, 1))) + 2)
    cosine = 1 - (1 - threshold) / max(spread, 1e-9)
    equal = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - equal))) if equal < 1 else 1


def _banded(vectors: DataFrame, threshold: float, block_size: int, recall: float, seed: int = 11) -> DataFrame:
    """Rows (band, key, a, b, side, id, vec, keys): groups of equal keys, large ones as pairs of blocks of bounded size.

    A block that meets itself comes once, as side 0.

    The mean of all unit vectors is taken off first, so hyperplanes part vectors that share a direction, unless that
    leaves a fiftieth of them so short that similar pairs would stand far apart.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = store(vectors.filter(norm > 0).withColumn("u", F.transform("vec", lambda x: x / norm)), "lsh_units")
    stats = unit.agg(Summarizer.mean(array_to_vector("u")).alias("mean"), F.count("*").alias("n")).first()
    mean = np.zeros(1) if stats["mean"] is None else stats["mean"].toArray()
    off = F.aggregate(F.zip_with("u", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    spread = unit.agg(F.percentile_approx(off, 0.02)).first()[0] or 1.0
    if spread < 1.5 * (1 - threshold):
        mean, spread = np.zeros(len(mean)), 1.0
    bits, bands = lsh_bands(threshold, spread, stats["n"], block_size, recall)
    planes = np.random.default_rng(seed).normal(size=(len(mean), bands * bits))
    weight = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def keys(u: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        side = (np.stack(u.to_list()) - mean) @ planes > 0
        return pd.Series(list(side.reshape(len(u), bands, bits) @ weight))

    rows = store(unit.select("id", "vec", keys("u").alias("keys")), "lsh_keys")
    sizes = rows.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count("*").alias("n"))
    # Only groups of more than a block are sent to the tasks, rows / block_size of a band at most; the vectors are shuffled once a band.
    large = sizes.filter(F.col("n") > block_size).select("band", "key", F.ceil(F.col("n") / block_size).cast("int").alias("parts"))
    each = rows.select("id", "vec", "keys", F.posexplode("keys").alias("band", "key")).join(F.broadcast(large), ["band", "key"], "left")
    at = each.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return at.select("band", "key", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"),
                     (F.col("blk") > F.col("other")).cast("int").alias("side"), "id", "vec", "keys")


def degrees(pages: Pages, threshold: float, decimals: int = 6) -> DataFrame:
    """(id, degree): how many other vectors are at or above the threshold; vectors without any are left out."""
    angle = pages.angle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for a, b, r, c, _ in _met(batches, threshold, decimals, angle):
            for page, at in ((a, r), (b, c))[:1 if a is b else 2]:
                ids, n = held.setdefault(page.key, (page.id, np.zeros(len(page.id), np.int64)))
                n += np.bincount(at, minlength=len(ids))
        for ids, n in held.values():
            yield from batches_of(id=ids[n > 0], n=n[n > 0])

    return pages.meetings().mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("degree"))


FOREST_EDGES = 1 << 20  # links that a task holds before it folds them into a forest


def core_graph(pages: Pages, flags: DataFrame, threshold: float, core_col: str = "core", decimals: int = 6) -> DataFrame:
    """(border, i, j, cosine): links that join all linked cores (border false), and per task the
    best core j of each other vector i (border true; ties to the smaller id). ``flags``: (id, core) of the vectors that have links."""
    angle = pages.angle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        links, n = [], 0
        for a, b, r, c, s in _met(batches, threshold, decimals, angle):
            core = a.flag[r] & b.flag[c]
            if core.any():
                links.append(star_forest(a.id[r[core]], b.id[c[core]]))
                n += len(links[-1][0])
            if n > FOREST_EDGES:
                links = [star_forest(*(np.concatenate(x) for x in zip(*links, strict=True)))]
                n = 0  # the forest has an edge a vector of the task at most
            for page, mine, other, k, to in ((a, r, c, ~a.flag[r] & b.flag[c], b), (b, c, r, ~b.flag[c] & a.flag[r], a))[:1 if a is b else 2]:
                new = page.id[mine[k]], to.id[other[k]], s[k]
                old = best.get(page.key)
                best[page.key] = _best(*(new if old is None else (np.concatenate(x) for x in zip(old, new, strict=True))), 1)
        if links:
            i, j = star_forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield from batches_of(border=np.zeros(len(i), bool), i=i, j=j, cosine=np.ones(len(i)))
        for i, j, s in best.values():
            yield from batches_of(border=np.ones(len(i), bool), i=i, j=j, cosine=s)

    return pages.meetings(flags, core_col).mapInArrow(run, "border boolean, i long, j long, cosine double")
