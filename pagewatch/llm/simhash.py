"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in at most r bits agree on at least one of r + 1
blocks of bits. The top level of the index is therefore the shared pattern of
one block: every fingerprint stands under r + 1 such nodes, and Spark shuffles
by node. Under a node the fingerprints stand in Gray order, where neighbours
differ in few bits; consecutive ones form the nodes of a tree that keeps the
bits on which all of a node agree. A pair of nodes is followed downwards while
the differences accumulated in bits that both have fixed stay within r, so
whole groups are pruned at once. Nodes that hold too many fingerprints for one
task are split by blocks of their remaining bits, by the same argument.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hot_join, merge_labels, write_table

SHINGLE = 3
RADIUS = 2
SEED = 42
NODE_ROWS = 4096     # a node of the shuffled level with more fingerprints is split further
FAN = 16             # children of a tree node
SLICE = 1 << 16      # shingles (or pairs of nodes) handled at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text, as a signed integer; no words: zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), SLICE):
        part = zip(starts[i:i + SLICE], ends[i:i + SLICE], strict=True)
        h = np.array([xxh64_intdigest(flat[s:e], SEED) for s, e in part], "<u8")
        at = np.arange(0, len(h), 255)  # eight counters of a byte each in one integer hold 255 bits
        for k in range(8):
            sums = np.add.reduceat(h >> np.uint64(k) & np.uint64(0x0101010101010101), at)
            ones[k::8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(F.col(f"`{text_col}`")))


def gray_links(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``codes`` (distinct, in Gray order) within ``radius`` bits: (index, smallest index of its group)."""
    fixed, pattern = [np.full(len(codes), ~np.uint64(0))], [codes]
    any_, all_ = codes, codes
    while len(all_) > 1:
        at = np.arange(0, len(all_), FAN)
        any_, all_ = np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at)
        fixed.append(~(any_ ^ all_))
        pattern.append(all_)
    labels = np.arange(len(codes))
    zero = np.zeros(1, np.int64)
    todo = [(len(fixed) - 1, zero, zero, np.zeros(1, np.uint8), np.zeros(1, np.uint64))]
    grid_a, grid_b = (g.ravel() for g in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    while todo:
        level, i, j, differ, seen = todo.pop()
        if level == 0:
            apart = i != j
            labels = merge_labels(labels, i[apart], j[apart])
            continue
        if len(i) > SLICE // (FAN * FAN):
            half = len(i) // 2
            todo += [(level, i[:half], j[:half], differ[:half], seen[:half]), (level, i[half:], j[half:], differ[half:], seen[half:])]
            continue
        a, b = (i[:, None] * FAN + grid_a).ravel(), (j[:, None] * FAN + grid_b).ravel()
        n = len(fixed[level - 1])
        ok = (a <= b) & (b < n)
        a, b, up = a[ok], b[ok], np.repeat(np.arange(len(i)), FAN * FAN)[ok]
        new = fixed[level - 1][a] & fixed[level - 1][b] & ~seen[up]
        d = differ[up] + np.bitwise_count((pattern[level - 1][a] ^ pattern[level - 1][b]) & new)
        ok = d <= radius
        if ok.any():
            todo.append((level - 1, a[ok], b[ok], d[ok], seen[up][ok] | new[ok]))
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return moved, labels[moved]


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` runs of nearly equal size, as masks."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cut = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in free[s:e]) for s, e in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _under(rows: DataFrame, paths: dict[str, int], radius: int) -> tuple[DataFrame, dict[str, int]]:
    """Each fingerprint under the radius + 1 nodes one level down from its ``path``."""
    below = {p: {f"{p}{i}": m | b for i, b in enumerate(_blocks(m, radius + 1))} for p, m in paths.items()}
    choices = F.create_map(*[x for p, kids in below.items() for x in (
        F.lit(p), F.array(*[F.struct(F.lit(k).alias("path"), F.lit(_signed(m)).alias("mask")) for k, m in kids.items()]))])
    rows = rows.select("fp", F.explode(choices[F.col("path")]).alias("n"))
    return rows.select("fp", F.col("n.path").alias("path"), F.col("fp").bitwiseAND(F.col("n.mask")).alias("node")), {k: m for kids in below.values() for k, m in kids.items()}


def links(prints: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within ``radius`` bits; no link joins others."""
    level, paths = _under(prints.select("fp", F.lit("").alias("path")), {"": 0}, radius)
    ready = []
    while True:
        level = write_table(level, "simhash_nodes")
        size = level.groupBy("path", "node").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows)
        size = write_table(size.withColumn("large", F.lit(True)), "simhash_large")
        if size.isEmpty():
            ready.append(level)
            break
        if all(64 - m.bit_count() <= radius for m in paths.values()):
            raise ValueError("node_rows is too small for the radius")
        marked = hot_join(level, size, ["path", "node"], "n", level.count())
        ready.append(marked.filter("large IS NULL").select("fp", "path", "node"))
        level, paths = _under(marked.filter("large"), paths, radius)
    nodes = reduce(DataFrame.unionByName, ready)
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
        nodes = nodes.withColumn("gray", rank)
        rank = F.col("gray")
    nodes = nodes.repartition("path", "node").sortWithinPartitions("path", "node", "gray")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the node that the last batch ended in: at most node_rows
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            start = np.flatnonzero(np.concatenate(([True], (pdf["node"].values[1:] != pdf["node"].values[:-1]) | (pdf["path"].values[1:] != pdf["path"].values[:-1]))))
            held = pdf.iloc[start[-1]:]
            yield _search(pdf["fp"].values, start[:-1], start[1:], radius)
        if held is not None:
            yield _search(held["fp"].values, np.array([0]), np.array([len(held)]), radius)

    return nodes.select("path", "node", "fp").mapInPandas(search, "a long, b long")


def _search(codes: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> pd.DataFrame:
    found = [(np.empty(0, np.int64),) * 2]
    for s, e in zip(start, end, strict=True):
        if e - s > 1:
            group = codes[s:e]
            i, j = gray_links(group.view(np.uint64), radius)
            found.append((group[i], group[j]))
    return pd.DataFrame({"a": np.concatenate([x[0] for x in found]), "b": np.concatenate([x[1] for x in found])})


def groups(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, n) per distinct fingerprint of ``prints`` (columns id_col, fp).

    component_id is the smallest id of any document reachable by links (null
    if none has an id), root names the component even then; n documents have fp.
    """
    fps = write_table(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "simhash_fps")
    roots = connected_components(links(fps, radius), "a", "b")
    fps = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    fps = write_table(fps, "simhash_roots")
    first = fps.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    # A component of very many fingerprints is a hot key here.
    return write_table(hot_join(fps, first, ["root"], "m", fps.count()).drop("first"), "simhash_groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Null or empty text: fingerprint zero, linked like any other. Null id: the
    row gets its component's id. Repeated rows stay. An empty table gives an empty result.
    """
    prints = with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", shingle)
    prints = write_table(prints.select("id", "fp"), "simhash_prints")
    found = groups(prints, "id", radius).select("fp", "component_id", "n")
    return hot_join(prints, found, ["fp"], "n", prints.count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (any one of repeated rows)."""
    # Texts are read twice and shuffled once: what is written are ids, fingerprints and 128 bits that tell
    # rows apart (two hashes of id and text), by which the rows are joined and repeated ones dropped.
    key = ["k1", "k2"]
    of = [F.col(f"`{c}`") for c in (id_col, text_col)]
    hashes = [F.xxhash64(*of, *[c.isNull() for c in of]).alias("k1"), F.xxhash64(F.lit(1), *of, *[c.isNull() for c in of]).alias("k2")]
    prints = docs.select(of[0].alias("id"), of[1].alias("text"), *hashes)
    prints = write_table(with_fingerprint(prints, "text", shingle).select("id", *key, "fp"), "simhash_prints")
    winners = hot_join(prints, groups(prints, "id", radius), ["fp"], "n", prints.count())
    winners = (winners.filter(F.col("id").eqNullSafe(F.col("component_id")))
               .groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*"))
    rows = docs.select(*hashes, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(winners, key).dropDuplicates(key).select("row.*")
