"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever makes a token of the vocabulary. Two neighbouring bytes that
stand side by side inside no token can therefore never end up in one token: a
cut between them is certain, and the two sides can be encoded apart and
concatenated. White space is the commonest such cut (no token of a vocabulary
that drops white space holds any); inside words the pairs are looked up.
Fragments repeat all through a corpus, so each is encoded once per task and kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 300_000       # entries that a task keeps before it starts afresh (memory only, never results)
MEMO_CHARS = 64      # longer fragments are encoded anew each time

# Cuts that hold before normalisation: blanks that the pre-tokeniser drops and
# that neither normal form nor lower-casing can join to a neighbour.
BLANK = " \t\n\r"
#: str.split() also cuts at these; a text that has one is cut at BLANK alone.
ODD_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NOT_BLANK = re.compile(f"[^{BLANK}]+")
#: Letters whose lower case is one letter and whose normal form is themselves, and ASCII.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The vocabulary's own split rule over PLAIN characters.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text), equal to the tokenizers library's."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        data = json.loads(spec)
        if not data["normalizer"] or data["pre_tokenizer"]["pretokenizers"][0].get("behavior") != "Removed" or data["decoder"]:
            raise ValueError("this codec is for vocabularies that drop white space and have no decoder")
        self.whole = Tokenizer.from_str(spec)
        open_ended = Tokenizer.from_str(spec)
        self.suffix = data["model"].get("end_of_word_suffix") or ""
        self.last, self.inner = self.whole.model, open_ended.model
        if self.suffix:
            self.inner.end_of_word_suffix = None  # for fragments that do not end a word
        self.kept_open = open_ended  # owns ``inner``
        self.names = {i: t for t, i in self.whole.get_vocab().items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Neighbours inside any token, in the byte alphabet of the vocabulary.
        self.joined: set[str] = set()
        for token in data["model"]["vocab"]:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.joined.update(body[i:i + 2] for i in range(len(body) - 1))
        self.alphabet = dict(enumerate(_byte_alphabet()))
        self.words = _Memo(self._word)
        self.chunks = _Memo(self._chunk)

    def fragments(self, word: str) -> list[str]:
        """``word`` (in the byte alphabet) cut wherever two neighbours stand together in no token."""
        joined = self.joined
        cuts = [i + 1 for i in range(len(word) - 1) if word[i:i + 2] not in joined]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _word(self, word: str) -> list[int]:
        *before, end = self.fragments(word)
        ids = [t.id for part in before for t in self.inner.tokenize(part)]
        return ids + [t.id for t in self.last.tokenize(end)]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a stretch without blanks."""
        ids: list[int] = []
        parts = self.special_re.split(chunk) if self.special_re else [chunk]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif PLAIN.fullmatch(part):
                for w in PLAIN_WORDS.findall(part.lower()):
                    ids += self.words[w if w.isascii() else self._spell(w)]
            elif part:
                normal = self.whole.normalizer.normalize_str(part)
                for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    ids += self.words[w]
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def _spell(self, word: str) -> str:
        return "".join(map(self.alphabet.__getitem__, word.encode()))

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives, special tokens kept: this vocabulary has no decoder, tokens are joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        for memo in (self.words, self.chunks):
            if len(memo) > MEMO:
                memo.clear()
        pieces = NOT_BLANK.findall(text) if ODD_BLANK.search(text) else text.split()
        both = list(map(self.chunks.__getitem__, pieces))
        return b"".join([x[0] for x in both]), " ".join([x[1] for x in both if x[0]])


@functools.lru_cache(maxsize=1)
def codec_of(spec: str) -> Codec:
    """The codec of this worker process, kept from task to task."""
    return Codec(spec)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a public rule)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``bpe``: n_tokens, ids (array<int>) and decoded text of every whole text.

    Null text counts as empty: no ids, empty decoded text. Rows are encoded where
    they are read (no shuffle); repeated rows, extra columns and an empty table need no care.
    ``vocabulary`` is the path of the vocabulary file, read once by the driver.
    """
    return _apply(docs, vocabulary, text_col, "n_tokens long, ids array<int>, decoded string",
                  lambda ids, text: (len(ids) // 4, np.frombuffer(ids, "<i4"), text))


def encode_decode_digests(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """As encode_decode, but struct ``bpe`` holds n_tokens and the SHA-256 of packed ids and decoded text."""
    return _apply(docs, vocabulary, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                  lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))


def _apply(docs: DataFrame, vocabulary: str, text_col: str, fields: str, made) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: a few MB whatever the corpus
    names = [x.split()[0] for x in fields.split(", ")]

    @F.pandas_udf(fields)
    def bpe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(spec.value)
        for texts in batches:
            yield pd.DataFrame([made(*codec.encode(t or "")) for t in texts], columns=names)

    return docs.withColumn("bpe", bpe(F.col(f"`{text_col}`")))
