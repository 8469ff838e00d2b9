"""Hashed character n-grams of whole texts, many texts at a time, in numpy."""

from __future__ import annotations

import functools

import numpy as np

SPACE = 32
_MIX = np.uint32(0x9E3779B1)


@functools.cache
def _folded() -> np.ndarray:
    """For each code point its lower case if that is a single letter, itself if a letter, else SPACE."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, starts): all texts lower-cased one after another, each run of other characters one SPACE.

    Every text begins and ends with a SPACE; text i is letters[starts[i]:starts[i + 1]].
    """
    raw = np.frombuffer("".join([f" {t or ''} " for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    cut = np.concatenate(([0], np.cumsum([len(t or "") + 2 for t in texts]))).astype(np.int64)
    code = _folded()[raw]
    keep = code != SPACE
    keep[1:] |= code[:-1] != SPACE
    keep[cut[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return code[keep], kept[cut]


def grams(letters: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram that starts at each letter (the last n - 1 positions are left out)."""
    m = max(len(letters) - n + 1, 0)
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h = (h ^ letters[k:k + m]) * _MIX
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def batches(texts, size: int = 1 << 21):
    """Lists of texts of about ``size`` characters, a longer text alone."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > size:
            yield part
            part, n = [], 0
        part.append(t or "")
        n += len(part[-1])
    if part:
        yield part
