"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram anywhere in the whole
text; its value is the log ratio of the shares of toxic and clean training
documents that have it. Logistic regression learns one weight a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams
from .common import columns, write_table

ORDERS = (4, 5)
BITS = 20
SAMPLE = (2000, 4000)   # at most so many toxic and clean labelled documents train it, the smallest by md5 of their id
MIN_DOCS = 5            # features of fewer training documents are left out
SMOOTHING = 1.0
L2 = 1e-4
ROUNDS = 80
BLOCK = 512
THRESHOLD = 0.3


class Model:
    """Weight of each hashed n-gram (0 for those without) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)


class Features:
    """Distinct hashed n-grams of texts; a table of last positions finds repeats without sorting."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int64)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        letters, starts = chargrams.fold(texts)
        ids = [chargrams.grams(letters, n, BITS) for n in ORDERS]
        for s, e in zip(starts, starts[1:], strict=False):
            doc = np.concatenate([x[s:max(e - n + 1, s)] for n, x in zip(ORDERS, ids, strict=True)])
            here = np.arange(len(doc))
            self.last[doc] = here
            yield doc[self.last[doc] == here]


def sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", bounds: tuple[int, int] = SAMPLE) -> DataFrame:
    """(id, y) of the training sample: the toxic and the clean ids that come first by md5, a bounded number of each."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.distinct().withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    first = [rows.filter(F.col("y") == y).orderBy("h", "id").limit(n) for y, n in ((1, bounds[0]), (0, bounds[1]))]
    return first[0].unionByName(first[1]).select("id", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the bounded sample of ``labels``; the prior is that of all labelled rows.

    Null labels and ids teach nothing. Of documents with one id the text with
    the smallest hash teaches, whatever the order of rows; an id labelled both ways counts as toxic. Without both classes the model scores
    every text with the share of toxic labels (0 without any).
    """
    share = labels.filter(F.col(f"`{label_col}`").isin(0, 1)).agg(F.avg(F.col(f"`{label_col}`").cast("double"))).first()[0] or 0.0
    picked = write_table(sample(labels, id_col, label_col), "toxic_sample")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features()
        for pdf in parts:
            found = [x.astype("<i4").tobytes() for t in pdf["text"] for x in f.of([t or ""])]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "n": [len(x) // 4 for x in found], "f": found})

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # At most sum(SAMPLE) ids are broadcast, and each map task sends one text an id on; the features of one text an id come to the driver to be fitted.
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(
        F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    table = write_table(rows.select("id", "y", "first.text").mapInPandas(features, "id long, y int, n long, f binary"), "toxic_features")
    got = columns(table.select("id", "y", "n"))
    order = np.argsort(got["id"], kind="stable")
    # The driver holds the sample's features once, in one array: they are read a partition at a time and then overwritten.
    ends = np.cumsum(got["n"][order])
    flat = np.empty(got["n"].sum(), np.int32)
    own = {i: flat[end - n:end] for i, n, end in zip(got["id"][order].tolist(), got["n"][order], ends, strict=True)}
    for row in table.select("id", "f").toLocalIterator():
        own[row["id"]][:] = np.frombuffer(row["f"], "<i4")
    return _fit_in_place([*own.values()], got["y"][order].astype(float), share)


def fit(features: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Naive Bayes scaling, then logistic regression by Adam on the whole sample; rows weigh as their class does among all labels."""
    return _fit_in_place([f.astype(np.int32) for f in features], y, share)


def _fit_in_place(features: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """``fit`` that overwrites the arrays of ``features``."""
    size = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(share, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size), np.log(share / (1 - share)))
    df = {label: np.zeros(size, np.int32) for label in (0, 1)}
    for f, label in zip(features, y, strict=True):
        df[int(label)][f] += 1  # a text's features are distinct
    ratio = np.log((df[1] + SMOOTHING) / (y.sum() + 2 * SMOOTHING)) - np.log((df[0] + SMOOTHING) / ((1 - y).sum() + 2 * SMOOTHING))
    used = df[0] + df[1] >= MIN_DOCS
    number, r = (np.cumsum(used) - 1).astype(np.int32), ratio[used]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weight /= weight.sum()
    # The column of each feature that is used takes the feature's place, so that the sample is held once.
    sizes = np.zeros(len(y), np.int64)
    for i, f in enumerate(features):
        cols = number[f[used[f]]]
        sizes[i] = len(cols)
        f[:len(cols)] = cols
    w, b = np.zeros(len(r) + 1), np.log(share / (1 - share))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        g, scaled = np.append(L2 * w[:-1], 0.0), r * w[:-1]
        for s in range(0, len(y), BLOCK):  # documents in blocks, so that what is computed for a block stays small
            here = slice(s, min(s + BLOCK, len(y)))
            col = np.concatenate([f[:n] for f, n in zip(features[here], sizes[here], strict=True)])
            row = np.repeat(np.arange(here.stop - s), sizes[here])
            z = np.bincount(row, scaled[col], minlength=here.stop - s) + w[-1]
            off = weight[here] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[here])
            g[:-1] += r * np.bincount(col, off[row], minlength=len(r))
            g[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
    full = np.zeros(size)
    full[used] = w[:-1] * r
    return Model(full, w[-1])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with double ``out`` from 0 to 1, higher the likelier the text is toxic.

    Null and empty texts get the score of a text without features. Rows are
    scored where they are read; repeated rows, extra columns and an empty
    table need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, f = shared.value, Features()
        for texts in parts:
            z = np.array([m.weights[x].sum(dtype=np.float64) for part in chargrams.batches(texts) for x in f.of(part)]) + m.intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))), dtype="float64")

    return docs.withColumn(out, scored(F.col(f"`{text_col}`")))
