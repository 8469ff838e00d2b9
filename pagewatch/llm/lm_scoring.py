"""LM scoring by cross-entropy difference.

A bigram model of the target text and one of the background share a
vocabulary, the set of bigrams and the smoothing; the background's counts
are scaled to the target's size, so the two are matched. A document's score is
the mean over its tokens of the target's loss less the background's: the lower,
the more it resembles the target.

The models hold every word and every bigram of both texts, whatever their
number, so no model is sent anywhere. Each document's bigrams are counted where
it is read and dealt to buckets by their second word; a bucket counts what it
gets of all texts, and gives each document its part of the losses. With the
losses of a bigram (v, w) go those of w as the word before the next one, which
needs w's counts too; an END after the last word takes back the one too many.
The most frequent words would fill a bucket each: their bigrams are dealt by
both words, and only their own counts (HOT_WORDS of them) are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, hot_join, write_table

PRIOR = 20.0            # pseudo-tokens by which a word's unigram model smooths what follows it
ADD = 0.5               # added to every word's count
BUFFER = 1 << 20        # characters whose words are hashed at once
COUNTED = 1 << 21       # tokens of which a task counts words before it hands on
BLOCK = 1 << 20         # tokens whose bigrams are sorted and dealt at once
ROWS = 64               # dealt rows that are handed on at once
HOT_WORDS = 1 << 10     # most frequent words, dealt by both words of a bigram; results do not depend on it
BUCKET = 1 << 20        # tokens a bucket, on average
MIN_BUCKETS = 64
START, END = np.uint64(1), np.uint64(2)  # before a text's first word; marks its last word
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every blank-separated lower-case word, number of words of each text)."""
    from xxhash import xxh64_intdigest

    words = [(t or "").lower().encode().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    return np.fromiter((xxh64_intdigest(x) for w in words for x in w), np.uint64, lengths.sum()), lengths


def _texts(batches, column: str = "text"):
    """Lists of texts of about BUFFER characters."""
    part, n = [], 0
    for pdf in batches:
        for t in pdf[column]:
            part.append(t)
            n += len(t or "")
            if n > BUFFER:
                yield part
                part, n = [], 0
    if part:
        yield part


def _last(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Last words of the texts that have any."""
    return hashes[np.cumsum(lengths)[lengths > 0] - 1]


def _count(rows: DataFrame) -> DataFrame:
    """(key, n, t, last_n, last_t): occurrences of each word in the background and in the target, and those that end a text."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def flush(side: bool):
            key, n = np.unique(np.concatenate([x for x, _ in held[side]]), return_counts=True)
            ends = np.concatenate([x for _, x in held[side]])
            last = np.bincount(np.searchsorted(key, ends), minlength=len(key))
            held[side] = []
            none = np.zeros(len(key), np.int64)
            return pd.DataFrame({"key": key.view(np.int64), "n": none if side else n, "t": n if side else none,
                                 "last_n": none if side else last, "last_t": last if side else none})

        for pdf in batches:
            for side in (False, True):
                for part in _texts([pdf[pdf["target"].to_numpy() == side]]):
                    hashes, lengths = tokens(part)
                    held[side].append((hashes, _last(hashes, lengths)))
                    if sum(len(x) for x, _ in held[side]) >= COUNTED:
                        yield flush(side)
        for side in (False, True):
            if held[side]:
                yield flush(side)

    sums = [F.sum(k).alias(k) for k in ("n", "t", "last_n", "last_t")]
    return rows.mapInPandas(count, "key long, n long, t long, last_n long, last_t long").groupBy("key").agg(*sums)


def _most_frequent(counts: DataFrame, bound: int) -> DataFrame:
    """The most frequent keys, at most ``bound``: all down to a frequency that depends on the counts alone."""
    grade = F.floor(F.log2(F.col("n") + F.col("t")) * 64)
    sizes = counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect()  # a few thousand grades at most
    total, lowest = 0, None
    for r in sizes:
        total += r["count"]
        if total > bound:
            break
        lowest = r["grade"]
    return counts.filter(grade >= lowest) if lowest is not None else counts.limit(0)


@dataclass
class Models:
    """The texts of both models and what all buckets need to know of them."""

    background: DataFrame
    target: DataFrame
    text_col: str
    target_text_col: str
    words: int       # size of the vocabulary
    tokens: dict     # of background (n) and target (t)
    texts: dict      # texts with words
    hot: dict        # counts of the most frequent words, sorted by key

    def __post_init__(self):
        self.scale = {"n": self.tokens["t"] / self.tokens["n"] if self.tokens["n"] else 1.0, "t": 1.0}

    def shared(self) -> dict:
        """What the tasks get: a few numbers and the hot words."""
        mass = {k: self.tokens[k] * self.scale[k] + ADD * (self.words + 1) for k in "nt"}
        start = {k: np.log(self.texts[k] * self.scale[k] + PRIOR) for k in "nt"}
        return {"scale": self.scale, "mass": mass, "start": start, "hot": self.hot,
                "buckets": max(MIN_BUCKETS, -(-(self.tokens["n"] + self.tokens["t"]) // BUCKET))}


def train(background: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text") -> Models:
    """Models of all texts of both tables; null and empty texts add nothing."""
    rows = background.select(F.col(f"`{text_col}`").alias("text"), F.lit(False).alias("target")).unionByName(
        target.select(F.col(f"`{target_text_col}`").alias("text"), F.lit(True).alias("target")))
    words = write_table(_count(rows), "lm_words")
    total = words.agg(F.count("*").alias("words"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n", "t", "last_n", "last_t")]).first()
    hot = columns(_most_frequent(words, HOT_WORDS))  # HOT_WORDS rows at most
    hot["key"] = hot["key"].view(np.uint64)
    order = np.argsort(hot["key"])
    return Models(background, target, text_col, target_text_col, total["words"], {k: total[k] for k in "nt"},
                  {k: total[f"last_{k}"] for k in "nt"}, {k: x[order] for k, x in hot.items()})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted keys, where)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(x) or int(x.max()) < 1 << 8 * s)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


DEALT = ("bucket int, block long, side string, scored boolean, words binary, n_bigrams binary, before binary, n_docs binary, "
         "docs binary, counts binary, keys array<string>, lengths binary")
PARTS = "block long, bucket int, docs binary, loss_t binary, loss_n binary, keys array<string>, lengths binary"


def _deal(hashes: np.ndarray, lengths: np.ndarray, scored: bool, buckets: int, hot: np.ndarray) -> Iterator[dict]:
    """A row for each bucket: its words; for each the words before it; for each of these the documents and the occurrences there."""
    has = np.flatnonzero(lengths)
    begin = (np.cumsum(lengths) - lengths)[has]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[begin] = START
    w = np.concatenate([hashes, _last(hashes, lengths)])
    v = np.concatenate([before, np.full(len(has), END)])
    doc = np.concatenate([np.repeat(np.arange(len(lengths)), lengths), has]).astype(np.uint32) if scored else np.zeros(len(w), np.uint32)
    spread = np.where(_find(hot, w)[0], (w ^ v * MIX) >> np.uint64(20), w)
    bucket = (spread % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.lexsort((v, w, bucket))  # stable: documents stay in order
    del spread, before, hashes
    w, v, doc, bucket = w[order], v[order], doc[order], bucket[order]
    del order
    word, bigram, entry = _starts(w, bucket), _starts(w, v), _starts(w, v, doc)
    n_bigrams = np.diff(np.append(np.searchsorted(bigram, word), len(bigram)))
    n_docs = np.diff(np.append(np.searchsorted(entry, bigram), len(entry)))
    counts = np.diff(np.append(entry, len(w)))
    edge = np.append(_starts(bucket), len(w))
    at = [np.searchsorted(x, edge) for x in (word, bigram, entry)]
    for i, b in enumerate(bucket[edge[:-1]]):
        x, y, z = (slice(a[i], a[i + 1]) for a in at)
        yield {"bucket": int(b), "words": w[word[x]].tobytes(), "n_bigrams": _pack(n_bigrams[x]), "before": v[bigram[y]].tobytes(),
               "n_docs": _pack(n_docs[y]), "docs": _pack(doc[entry[z]]), "counts": _pack(counts[z])}


def _bucket_losses(pdf: pd.DataFrame, shared: dict) -> Iterator[dict]:
    """Each scored block's documents with the sums of their losses in this bucket."""
    rows = pdf[pdf["words"].notna()].sort_values("block").to_dict("records")
    if not rows:
        return
    w = np.concatenate([np.repeat(np.frombuffer(r["words"], np.uint64), _unpack(r["n_bigrams"])) for r in rows])
    v = np.concatenate([np.frombuffer(r["before"], np.uint64) for r in rows])
    found = {"n": [], "t": []}
    for r in rows:
        n_docs = _unpack(r["n_docs"]).astype(np.int64)
        total = np.add.reduceat(_unpack(r["counts"]).astype(np.int64), np.cumsum(n_docs) - n_docs)
        for k in "nt":
            found[k].append(total if r["side"] == k else np.zeros(len(total), np.int64))
    order = np.lexsort((v, w))
    w, v = w[order], v[order]
    first = _starts(w, v)
    at = np.empty(len(w), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))  # bigram of each row
    w, real = w[first], v[first] != END
    word = _starts(w)
    of = np.repeat(np.arange(len(word)), np.diff(np.append(word, len(w))))
    hot, there = _find(shared["hot"]["key"], w[word])
    loss = {}
    for k in "nt":
        pair = np.bincount(at, np.concatenate(found[k]))
        uni, last = (np.bincount(of, pair * x) for x in (real, ~real))
        uni[hot], last[hot] = shared["hot"][k][there[hot]], shared["hot"][f"last_{k}"][there[hot]]
        after = np.log((uni - last) * shared["scale"][k] + PRIOR)[of]
        smooth = (PRIOR * (uni * shared["scale"][k] + ADD) / shared["mass"][k])[of]
        loss[k] = np.where(real, after - np.log(pair * shared["scale"][k] + smooth), -after)
    begin = 0
    for r in rows:
        n_docs = _unpack(r["n_docs"])
        mine = at[begin:begin + len(n_docs)]
        begin += len(n_docs)
        if r["scored"]:
            docs, inverse = np.unique(_unpack(r["docs"]), return_inverse=True)
            counts = _unpack(r["counts"])
            yield {"block": r["block"], "docs": _pack(docs)} | {
                f"loss_{k}": np.bincount(inverse, np.repeat(loss[k][mine], n_docs) * counts).tobytes() for k in "nt"}


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype(object).where(lambda x: x.notna(), None)


def _sums(rows: DataFrame, models: Models) -> DataFrame:
    """(key, copies, n_tokens, loss_t, loss_n) of each text of the scored rows: sums over its copies."""
    shared = rows.sparkSession.sparkContext.broadcast(models.shared())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        m, block = shared.value, TaskContext.get().partitionId() << 32
        held: dict[tuple, list[tuple]] = {}

        def flush(kind: tuple) -> Iterator[pd.DataFrame]:
            nonlocal block
            side, scored = kind
            hashes, lengths, keys = (np.concatenate(x) for x in zip(*held.pop(kind), strict=True))
            same, out = {"block": block, "side": side, "scored": scored}, []
            if scored:
                out.append({"bucket": block * 31 % m["buckets"], "keys": list(keys), "lengths": _pack(lengths)} | same)
            for row in _deal(hashes, lengths, scored, m["buckets"], m["hot"]["key"]) if len(hashes) else ():
                out.append(row | same)
                if len(out) == ROWS:
                    yield _frame(out, DEALT)
                    out = []
            if out:
                yield _frame(out, DEALT)
            block += 1

        for pdf in batches:
            for kind, part in pdf.groupby(["side", "scored"], sort=True):
                keys = part["key"].to_numpy(object)
                for texts in _texts([part]):
                    held.setdefault(kind, []).append((*tokens(texts), keys[:len(texts)]))
                    keys = keys[len(texts):]
                    if sum(len(x[0]) for x in held[kind]) >= BLOCK:
                        yield from flush(kind)
        for kind in list(held):
            yield from flush(kind)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(_bucket_losses(pdf, shared.value))
        out += pdf.loc[pdf["words"].isna(), ["block", "keys", "lengths"]].to_dict("records")
        return _frame([x | {"bucket": pdf["bucket"].iloc[0]} for x in out], PARTS)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf["docs"].isna()
        head = pdf[named].iloc[0]
        lengths = _unpack(head["lengths"])
        loss = {k: np.where(lengths > 0, shared.value["start"][k], 0.0) for k in "nt"}
        for r in pdf[~named].sort_values("bucket").to_dict("records"):
            docs = _unpack(r["docs"])
            for k in "nt":
                loss[k][docs] += np.frombuffer(r[f"loss_{k}"])
        return pd.DataFrame({"key": list(head["keys"]), "n_tokens": lengths.astype(np.int64), "loss_t": loss["t"], "loss_n": loss["n"]})

    parts = rows.mapInPandas(deal, DEALT).groupBy("bucket").applyInPandas(bucket, PARTS)
    losses = parts.groupBy("block").applyInPandas(gather, "key string, n_tokens long, loss_t double, loss_n double")
    return losses.groupBy("key").agg(F.count("*").alias("copies"), *[F.sum(k).alias(k) for k in ("n_tokens", "loss_t", "loss_n")])


def score(docs: DataFrame, models: Models, text_col: str = "text", out: str = "lm") -> DataFrame:
    """``docs`` with struct ``out``: n_tokens, target_loss, background_loss (means per token) and score, their difference.

    Null and empty texts: no tokens, all three 0. Rows find their losses by the
    MD5 of their text; repeated rows, extra columns and an empty table need no
    care. If ``docs`` is the models' background itself, its texts are dealt once.
    """
    def texts(df: DataFrame, column: str, side: str, scored: bool) -> DataFrame:
        text = F.col(f"`{column}`")
        return df.select(text.alias("text"), F.lit(side).alias("side"), F.lit(scored).alias("scored"),
                         (key(text) if scored else F.lit("")).alias("key"))

    def key(text):
        return F.md5(F.coalesce(text, F.lit("")).cast("binary"))

    same = docs is models.background and text_col == models.text_col
    rows = texts(models.background, models.text_col, "n", same).unionByName(texts(models.target, models.target_text_col, "t", False))
    if not same:
        rows = rows.unionByName(texts(docs, text_col, "", True))
    tokens_of = F.greatest("n_tokens", F.lit(1))
    mean = {k: F.col(f"loss_{k}") / tokens_of for k in "nt"}
    sums = write_table(_sums(rows, models).select(
        F.col("key").alias("_lm_key"), "copies",
        F.struct((F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"), mean["t"].alias("target_loss"),
                 mean["n"].alias("background_loss"), (mean["t"] - mean["n"]).alias("score")).alias("_lm")), "lm_scores")
    total = sums.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = hot_join(docs.withColumn("_lm_key", key(F.col(f"`{text_col}`"))), sums, ["_lm_key"], "copies", total)
    return joined.withColumn(out, F.col("_lm")).select(*[f"`{c}`" for c in docs.columns if c != out], out)
