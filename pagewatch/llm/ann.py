"""Approximate nearest neighbours by multi-index hashing.

Vectors are turned by learned rotations and reduced to the signs of their
coordinates. A code is split into substrings; each substring is an index of its
own from value to rows. A code within r bits of a query's has, by the
pigeonhole principle, a substring within r / m bits of the query's, so looking
up all substring values that near retrieves every code within r. The radius
grows until enough codes are retrieved; those are ranked by the inner product
of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, write_table
from .embedding_dedup import clean

ROTATIONS = 4          # each gives one bit per dimension
MIN_BITS = 256         # more rotations are learned where the dimensions are few
SAMPLE = 10_000        # vectors that the rotations are learned from: the first by hash of their id
ROUNDS = 30
SHARD_ROWS = 16_384    # rows of the index that a task holds
QUERY_ROWS = 2048      # queries that it holds
RETRIEVE = 320         # codes that a query retrieves of each shard, at least
STEP = 8               # bits by which the radius grows


def learn_rotations(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> list[np.ndarray]:
    """Orthogonal matrices that bring the sample's vectors near the corners of a cube (iterative quantisation)."""
    dim = sample.shape[1]
    rng, out = np.random.default_rng(seed), []
    for _ in range(max(ROTATIONS, -(-MIN_BITS // dim))):
        r, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        for _ in range(rounds if len(sample) else 0):
            u, _, vt = np.linalg.svd(sample.T @ np.sign(sample @ r))
            r = u @ vt
        out.append(r)
    return out


def codes(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Rows of bytes: the signs of all rotated coordinates, padded to whole 64-bit words."""
    bits = np.concatenate([x @ r > 0 for r in rotations], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)


UNSEEN = 1 << 14
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]).astype(np.int8)


class MultiIndex:
    """One index per byte of the codes: rows ordered by the byte's value and where each value begins."""

    def __init__(self, code: np.ndarray):
        self.words = np.ascontiguousarray(code.view(np.uint64).T)
        self.m = code.shape[1]
        self.bytes = np.ascontiguousarray(code.T)
        self.rows = np.argsort(self.bytes, axis=1, kind="stable").astype(np.int32)
        self.count = np.stack([np.bincount(b, minlength=256) for b in self.bytes])
        self.begin = np.cumsum(self.count, axis=1) - self.count

    def probe(self, code: np.ndarray) -> "Probe":
        return Probe(self, code)

    def marked(self, s: int, byte: int, low: int, high: int) -> np.ndarray:
        """Which rows' byte ``s`` differs from ``byte`` in low to high bits: from their lists, or from the column where they are many."""
        near = (_NEAR[byte] >= low) & (_NEAR[byte] <= high)
        n = self.count[s][near]
        if 8 * n.sum() > self.words.shape[1]:
            bits = np.bitwise_count(self.bytes[s] ^ byte)
            return (bits >= low) & (bits <= high)
        out = np.zeros(self.words.shape[1], bool)
        start = self.begin[s][near]
        out[self.rows[s][np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return out

    def distances(self, rows: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Bits in which the codes of the marked rows differ from ``word``; UNSEEN for the others."""
        out = np.full(len(rows), UNSEEN, np.int16)
        few = np.flatnonzero(rows) if 4 * rows.sum() < len(rows) else slice(None)
        d = sum(np.bitwise_count(column[few] ^ w).astype(np.int16) for column, w in zip(self.words, word, strict=True))
        out[few] = d
        out[~rows] = UNSEEN
        return out


class Probe:
    """Retrieval for one query by growing radius; each list is looked up once."""

    def __init__(self, index: MultiIndex, code: np.ndarray):
        self.index, self.code, self.word = index, code, code.view(np.uint64)
        self.reach = [-1] * index.m
        self.seen = np.zeros(index.words.shape[1], bool)
        self.distance = np.full(index.words.shape[1], UNSEEN, np.int16)

    def within(self, radius: int) -> np.ndarray:
        """Rows of every code within ``radius`` bits (not smaller than at the call before)."""
        low, extra = divmod(radius, self.index.m)
        fresh = np.zeros(len(self.seen), bool)
        for s, byte in enumerate(self.code):
            reach = low if s <= extra else low - 1  # m substrings that all differ more sum to over radius
            if reach > self.reach[s]:
                fresh |= self.index.marked(s, byte, self.reach[s] + 1, reach)
                self.reach[s] = reach
        fresh &= ~self.seen
        self.seen |= fresh
        self.distance = np.minimum(self.distance, self.index.distances(fresh, self.word))
        return np.flatnonzero(self.distance <= radius)


def _augment(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate makes all vectors equally long, so the nearest by angle has the largest inner product."""
    u = x / top
    return np.concatenate((u, np.sqrt(np.maximum(1 - (u * u).sum(1, keepdims=True), 0))), axis=1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           retrieve: int = RETRIEVE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` rows of largest inner product among those retrieved.

    Rows with the query's own id are no candidates. Vectors that are null,
    zero or hold null or non-finite components, and rows with a null id take no
    part. A query is searched among all vectors of its own length; each length
    has rotations, shards and blocks of its own. Ties go to the smaller id; a
    repeated id counts once (its largest score). Every row of ``vectors`` whose length is asked for is
    indexed; each (length, shard, block of queries) is one bounded task. An empty table gives an empty result.
    """
    spark = vectors.sparkSession

    def part(df: DataFrame, name: str) -> DataFrame:
        rows = clean(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("e")), "e")
        rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").select(
            "id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
        return write_table(rows, name)

    index, asked = part(vectors, "ann_rows"), part(queries, "ann_queries")
    asked_of = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}  # a row for each length
    found_of = index.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy("dim").collect()
    found_of = {r["dim"]: r for r in found_of if r["dim"] in asked_of}
    top = {dim: r["top"] for dim, r in found_of.items()}
    order, rotations = F.xxhash64("id"), {}
    for dim in found_of:
        picked = index.filter(F.col("dim") == dim).select(order.alias("h"), "id", "v").orderBy("h", "id").limit(SAMPLE)
        rotations[dim] = learn_rotations(_augment(np.stack(columns(picked)["v"]).astype(float), top[dim]))
    model = spark.sparkContext.broadcast(rotations)
    grid = spark.createDataFrame([(dim, max(1, -(-r["n"] // shard_rows)), max(1, -(-asked_of[dim] // query_rows))) for dim, r in found_of.items()],
                                 "dim int, shards int, blocks int")

    # A grid of shards and blocks of queries for each length: every stated query meets every shard of its length once.
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit("deal")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index, asked = (x.join(F.broadcast(grid), "dim") for x in (index, asked))  # a row for each length
    rows = index.select("dim", deal("shards").alias("shard"), every("blocks").alias("block"), F.lit(False).alias("asks"), "id", "v")
    rows = rows.unionByName(asked.select("dim", deal("blocks").alias("block"), every("shards").alias("shard"), F.lit(True).alias("asks"), "id", "v"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out = []
        if asks.any() and not asks.all():
            pdf = pdf.sort_values(["asks", "id"])
            ids, x = pdf["id"].to_numpy(), np.stack(pdf["v"].to_list()).astype(float)
            n, dim = int((~asks).sum()), x.shape[1]
            found = MultiIndex(codes(_augment(x[:n], top[dim]), model.value[dim]))
            unit = x[n:] / np.linalg.norm(x[n:], axis=1, keepdims=True)
            q_codes = codes(np.concatenate((unit, np.zeros((len(unit), 1))), axis=1), model.value[dim])
            bits, radius = q_codes.shape[1] * 8, 0
            for q, qx, code in zip(ids[n:], x[n:], q_codes, strict=True):
                radius = max(radius - STEP, 0)  # the radius of the query before is a first guess
                probe = found.probe(code)
                while True:
                    near = probe.within(radius)
                    near = near[ids[:n][near] != q]
                    if len(near) >= retrieve or radius >= bits:
                        break
                    radius += STEP
                score = (x[:n][near] * qx).sum(1)
                best = np.lexsort((ids[:n][near], -score))
                best = best[np.unique(ids[:n][near][best], return_index=True)[1]] if len(near) else best
                best = best[np.lexsort((ids[:n][near][best], -score[best]))][:k]
                out += [(q, i, s) for i, s in zip(ids[:n][near][best], score[best], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = rows.groupBy("dim", "shard", "block").applyInPandas(look, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def brute_force(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int = 20) -> np.ndarray:
    """Ids of the exact answer, to measure recall."""
    score = (vectors * query).sum(1)
    order = np.lexsort((ids, -score))
    return ids[order[ids[order] != own]][:k]
