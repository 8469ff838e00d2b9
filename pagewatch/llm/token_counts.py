"""Token counts of huge documents by overlap resynchronisation.

A huge text is cut into chunks that overlap; every chunk is a row of its own,
encoded whole, with offsets. Where two neighbours overlap their encodings are spliced at a
common boundary that is proven stable, in one of two ways:

- Both have a piece of the split pattern begin there, and not at the left chunk's ragged end. The pattern looks at what
  follows, never at what came before, so from there on the right chunk's pieces are those of the whole text.
- The overlap lies within one piece of either (a long run without blanks), and both hold the same token there. A sequence of
  byte pair tokens is the encoding of its text if each two neighbours are the encoding of theirs. All neighbours left of
  the token's end are neighbours in the left encoding, it and all that follows in the right one.

The numbers of tokens left and right of the boundaries are added up. Where an overlap has no such boundary, it alone is
widened and its two chunks are encoded again; two chunks whose overlap would be half a chunk, or is all of the second, become one. A text whose
tokens never fall into step (a run of one letter, say) ends as one chunk.

Texts of one chunk are cut into units at stable boundaries, and each new unit is encoded once a task.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, write_table

CHUNK = 32_768       # characters that a chunk adds; texts up to this size are one chunk
OVERLAP = 256        # characters that it shares with the next at first
LIMIT = 1024         # over_limit: more tokens than this
MEMO = 200_000       # units whose counts a task keeps (memory only, never results)
MEMO_CHARS = 48
SLICE = 8192         # new units that the library encodes at once: its results are much larger than the counts

#: Units of a text whose only blanks are space and newline: they end at every stable boundary.
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Stable boundaries of any text: before a blank of every engine, after a character that is blank in none.
STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​-‏⁠﻿])(?=[ \n])")


class UnitCounter:
    """Token counts as the tokenizers library gives them, special strings in texts as its default."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[list[str]]) -> list[list[int]]:
        """Tokens of each unit of each text; units new to this task go to the library in one batch."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*texts).difference(memo)) if texts else []
        fresh = {}
        for i in range(0, len(new), SLICE):
            part = new[i:i + SLICE]
            fresh.update((u, len(e)) for u, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True))
        long = {u: n for u, n in fresh.items() if len(u) > MEMO_CHARS}
        memo.update(fresh)
        out = [list(map(memo.__getitem__, units)) for units in texts]
        for u in long:
            del memo[u]
        return out


@functools.lru_cache(maxsize=1)
def unit_counter(spec: str) -> UnitCounter:
    """The counter of this worker process, kept from task to task."""
    return UnitCounter(spec)


def units(text: str) -> list[str]:
    """``text`` cut at stable boundaries."""
    if text.replace("\n", "").isprintable():
        return UNIT.findall(text)
    return STABLE.split(text)


def _batches(texts, size: int = 1 << 20):
    """Lists of texts of about ``size`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Struct ``row`` (the ``keep`` columns of ``docs``, all by default), n_bytes and n_tokens of every whole text.

    Null or empty text: 0 and 0. ``overlap`` is raised to twice the longest special string. Repeated rows and null ids are kept as they
    are: huge texts are spliced by the digest of their text, once for all
    copies. An empty table gives an empty result. ``vocabulary`` is the path
    of a byte-level vocabulary file, read by the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary: a few MB whatever the corpus

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = unit_counter(spec.value)
        for texts in batches:
            yield pd.Series([sum(n) for part in _batches(texts) for n in counter.counts([units(t) for t in part])], dtype="int64")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_huge = F.length("text") > chunk
    small = rows.filter(~is_huge).select("row", "n_bytes", whole("text").alias("n_tokens"))
    texts = rows.filter(is_huge).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    huge = write_table(texts.select("row", "n_bytes", "digest"), "huge_texts")
    if huge.isEmpty():
        return small

    texts = texts.select("digest", "text")
    sizes = texts.select("digest", F.length("text").cast("long").alias("size")).distinct()
    longest = max((len(t["content"]) for t in json.loads(spec.value).get("added_tokens", [])), default=0)
    overlap = min(max(overlap, 2 * longest + 2), max(chunk, 2 * longest + 2))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long")))
    spans = sizes.select("digest", "size", begin.alias("start"))
    spans = spans.withColumn("stop", F.least(F.col("start") + chunk, "size")).select(
        "digest", "start", "stop", F.when(F.col("start") > 0, overlap).otherwise(0).cast("long").alias("left"),
        F.when(F.col("stop") < F.col("size"), overlap).otherwise(0).cast("long").alias("right"))
    key = ["digest", "start", "stop", "left", "right"]
    encoded, counted = None, None
    while True:
        new = write_table(_pieces(texts, spans).mapInPandas(_encoder(spec, longest), ENCODED).dropDuplicates(key), "chunks")  # copies give equal rows
        # What goes on is written each round, so that no plan holds the rounds before.
        encoded = new if encoded is None else write_table(encoded.unionByName(new), "chunks")
        spliced = write_table(encoded.groupBy("digest").applyInPandas(_splicer(chunk), SPLICED), "spliced")
        got = spliced.filter("n_tokens IS NOT NULL").select("digest", "n_tokens")
        counted = got if counted is None else counted.unionByName(got)
        left = spliced.filter("n_tokens IS NULL").select("digest", F.explode("spans").alias("s")).select("digest", "s.*")
        if left.isEmpty():
            break
        spans = left.filter("again").drop("again")
        encoded = encoded.join(left.filter("NOT again").drop("again"), key, "left_semi")
    copies = huge.groupBy("digest").count()
    return small.unionByName(hot_join(huge, copies.join(counted, "digest"), ["digest"], "count", huge.count()).drop("digest"))


SPAN = "start long, stop long, left long, right long"
ENCODED = f"digest string, {SPAN}, total long, head map<string,long>, tail map<string,long>"
SPLICED = "digest string, n_tokens long, spans array<struct<start:long,stop:long,left:long,right:long,again:boolean>>"
PIECES = 1 << 20  # characters of pieces that are handed on at once


def _pieces(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, start, stop, left, right, piece): the chunks of each text with what they share with the next, spread evenly over tasks."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for digest, text, wanted in zip(pdf["digest"], pdf["text"], pdf["spans"], strict=True):
                rows, n = [], 0
                for s in wanted:
                    rows.append((digest, s["start"], s["stop"], s["left"], s["right"], text[s["start"]:s["stop"] + s["right"]]))
                    n += len(rows[-1][-1])
                    if n > PIECES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, n = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["digest", "start", "stop", "left", "right", "piece"]
    of = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "stop", "left", "right")).alias("spans"))
    return texts.join(of, "digest").mapInPandas(cut, f"digest string, {SPAN}, piece string").repartition("digest", "start")


class Layout:
    """Where the tokens of a chunk's encoding begin and end in its text, and which piece of the split pattern each is of."""

    def __init__(self, encoding, start: int):
        at = np.fromiter(itertools.chain.from_iterable(encoding.offsets), np.int64, 2 * len(encoding)) + start
        self.first, self.last = at[::2], at[1::2]
        self.words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        self.ids = encoding.ids
        self.clean = np.ones(len(self.first), bool)
        self.clean[1:] = self.first[1:] >= self.last[:-1]  # not within a character
        self.begins = self.clean.copy()
        self.begins[1:] &= (self.words[1:] != self.words[:-1]) | (self.words[1:] < 0)

    def common_places(self, low: int, high: int, longest: int, head: bool) -> dict[str, int]:
        """Names of the places in [low, high] at which the encoding can be spliced, with the tokens before each.

        ``head``: the places are shared with the chunk before, else with the one after. ``longest``: special string.
        """
        first, last, words = self.first, self.last, self.words
        end = len(first) if head else int(np.flatnonzero(self.begins)[-1])  # what the last piece would be in the whole text is not known
        some = slice(*np.searchsorted(first[:end], [low, (high if head else high - longest) + 1]))
        k = np.flatnonzero(self.begins[some]) + some.start
        out = {f"b{p}": int(n) for p, n in zip(first[k], k, strict=True)}
        run = words[0] if head else words[-1]
        some = slice(int(np.searchsorted(last, low, "right")), int(np.searchsorted(first, high)))
        if some.stop > some.start and run >= 0 and (words[some] == run).all() and (head or first[np.flatnonzero(words == run)[0]] <= low):
            ends = np.append(self.clean[1:], True)[some]
            k = np.flatnonzero(self.clean[some] & ends & (first[some] >= low) & (last[some] <= high)) + some.start
            out |= {f"t{first[i]}-{last[i]}-{self.ids[i]}": int(i) + 1 for i in k}
        return out


def _encoder(spec, longest: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = unit_counter(spec.value).tok
        for pdf in batches:
            rows = []
            for digest, start, stop, left, right, piece in pdf.itertuples(index=False):
                e = Layout(tok.encode(piece, add_special_tokens=False), start)
                rows.append((digest, start, stop, left, right, len(e.ids), e.common_places(start, start + left, longest, True) if left else {},
                             e.common_places(stop, stop + right, longest, False) if right else {}))
            yield pd.DataFrame(rows, columns=["digest", "start", "stop", "left", "right", "total", "head", "tail"])

    return encode


def _splicer(chunk: int):
    """Splice the chunks of one text (a row for each ``chunk`` characters of it): its tokens, or the chunks to go on with."""
    def splice(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("start").to_dict("records")
        for r in rows:
            r["head"], r["tail"] = dict(r["head"]), dict(r["tail"])
        total, before, failed = 0, 0, []
        for i, (r, after) in enumerate(zip(rows, [*rows[1:], None], strict=True)):
            if after is None:
                total += r["total"] - before
                continue
            place = next((p for p in r["tail"] if p in after["head"]), None)
            if place is None:
                failed.append(i)
            else:
                total, before = total + r["tail"][place] - before, after["head"][place]
        if not failed:
            return pd.DataFrame({"digest": [rows[0]["digest"]], "n_tokens": [total], "spans": [None]})
        spans = [{k: int(r[k]) for k in ("start", "stop", "left", "right")} | {"again": False} for r in rows]
        size = spans[-1]["stop"]
        merged = -1
        for i in failed:
            a, b = spans[i], spans[i + 1]
            if 4 * a["right"] <= chunk and a["right"] < size - a["stop"]:  # what reaches the text's end cannot be widened
                a["right"] = b["left"] = min(2 * a["right"], size - a["stop"])
                a["again"] = b["again"] = True
            elif merged != i:  # one of two such overlaps in a row at a time
                merged = i + 1
                spans[i + 1] = {"start": a["start"], "stop": b["stop"], "left": a["left"], "right": b["right"], "again": True}
                spans[i] = None
        return pd.DataFrame({"digest": [rows[0]["digest"]], "n_tokens": [None], "spans": [[s for s in spans if s]]}).astype({"n_tokens": "Int64"})

    return splice
