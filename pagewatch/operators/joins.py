"""Helpers for keys that hold a large share of all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key that holds more than one row in HOT_SHARE is hot. There can be at most
# HOT_SHARE such keys whatever the table's size, which bounds their broadcast.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key) without a hot task.

    ``right`` carries in ``count_col`` how many left rows have the key. Keys
    with more than ``total / HOT_SHARE`` rows (at most HOT_SHARE of them) are
    broadcast, so their left rows stay where they are; the others are joined
    by shuffle. ``left`` is read twice: pass a written table.
    """
    values = [c for c in right.columns if c not in keys and c != count_col]
    limit = max(total // HOT_SHARE, 1)
    hot = right.filter(F.col(count_col) > limit).select(*keys, *values, F.lit(True).alias("_hot"))
    cold = right.filter(F.col(count_col) <= limit).select(*keys, *values)
    marked = left.join(F.broadcast(hot), keys, "left")
    done = marked.filter("_hot").drop("_hot")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return done.unionByName(rest)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of index pairs (a[i], b[i]); ``labels`` points every index to its component's smallest."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def star_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component) of the edges src[i] - dst[i]; the smallest nodes themselves are left out."""
    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    label = merge_labels(np.arange(len(ids)), at[:len(src)], at[len(src):])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]
