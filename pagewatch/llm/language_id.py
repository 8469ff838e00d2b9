"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed character trigrams. A document is
a mixture of languages: expectation-maximisation finds the proportions under
which its trigrams are likeliest, and the set of languages is the one with the
best penalised likelihood. The prediction is the language with the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams
from .common import columns, write_table

ORDER = 3
BITS = 16
SMOOTHING = 0.1     # added to each trigram's count
PENALTY = 3.0       # log-likelihood that a further language must gain, times log(trigrams): each letter stands in three trigrams
ROUNDS = 15
UNKNOWN = "und"
RESULT = "lang string, score double, shares map<string,double>"


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x trigrams."""
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T) if langs else np.zeros((1 << BITS, 0))
        self.log = np.log(self.p)


def count_trigrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language; languages x 2^BITS rows at most."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in parts:
            for lang, texts in pdf.groupby("lang")["text"]:
                for part in chargrams.batches(texts):
                    letters, _ = chargrams.fold(part)
                    pause = letters == chargrams.SPACE
                    inside = ~(pause[1:] & pause[:-1])  # two spaces stand only between two texts
                    ids = chargrams.grams(letters, ORDER, BITS)[inside[1:] & inside[:-1]]
                    n = np.bincount(ids, minlength=1 << BITS)
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at.astype("int32"), "n": n[at]})

    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    return rows.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all labelled rows; null text or language teaches nothing."""
    table = columns(write_table(count_trigrams(docs, lang_col, text_col), "trigrams"))
    langs, which = np.unique(table["lang"].astype(str), return_inverse=True)
    counts = np.zeros((len(langs), 1 << BITS))
    counts[which, table["gram"]] = table["n"]
    langs = langs.tolist()
    return Model(langs, counts)


def mixture(p: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns of ``p`` (probabilities of the seen trigrams) and the log-likelihood."""
    share, n = np.full(p.shape[1], 1.0 / p.shape[1]), counts.sum()
    for _ in range(rounds):
        new = share * ((counts / (p @ share)) @ p) / n
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def infer(model: Model, ids: np.ndarray) -> dict[str, float]:
    """Proportions of the chosen languages from the trigram ids of one document."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    seen, counts = ids[first], np.diff(np.concatenate((first, [len(ids)]))).astype(float)
    p, single = model.p[seen], counts @ model.log[seen]
    price = PENALTY * np.log(max(counts.sum(), 2.0))
    best, gain = [int(single.argmax())], single.max()
    shares = np.ones(1)
    if len(model.langs) > 1:
        full, top = mixture(p, counts)
        if top - gain > price:  # no set can be likelier than all languages together
            order = np.argsort(-full, kind="stable")
            for k in range(2, len(order) + 1):
                chosen = list(order[:k])
                s, ll = mixture(p[:, chosen], counts, 4 * ROUNDS)
                if ll - price * (k - 1) > gain:
                    best, shares, gain = chosen, s, ll - price * (k - 1)
    return {model.langs[i]: float(s) for i, s in zip(best, shares, strict=True)}


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with struct ``out``: lang, score (its proportion) and the proportions of all chosen languages.

    Texts that are null or have no letter: UNKNOWN, score 0. Without any
    learned language every text is UNKNOWN. Ties go to the language first in
    order. Rows are scored where they are read; repeated rows, extra columns and an empty table need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^BITS probabilities

    @F.pandas_udf(RESULT)
    def lang(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            out = []
            for part in chargrams.batches(texts):
                letters, starts = chargrams.fold(part)
                ids = chargrams.grams(letters, ORDER, BITS).astype(np.uint16)
                for s, e in zip(starts, starts[1:], strict=False):
                    if e - s < 3 or not m.langs:  # folded to a space or two: no letter
                        out.append((UNKNOWN, 0.0, {}))
                        continue
                    shares = infer(m, ids[s:e - ORDER + 1])
                    top = max(shares, key=lambda x: (shares[x], -m.langs.index(x)))
                    out.append((top, min(shares[top], 1.0), shares))
            yield pd.DataFrame(out, columns=["lang", "score", "shares"])

    return docs.withColumn(out, lang(F.col(f"`{text_col}`")))
