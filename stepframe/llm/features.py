"""Hashed text features in numpy: character n-grams and words with their prefixes, over whole texts."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

from stepframe.llm.arrow_text import gather

MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, two NULs behind each, and where each text starts and ends."""
    low = [(t or "").lower().replace("\0", " ") for t in texts]
    points = np.frombuffer(("\0\0".join(low) + "\0\0").encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.cumsum(lens + 2) - (lens + 2)
    return points, starts, starts + lens


def ngram_counts(texts: list[str | None], bits: int, orders: tuple[int, ...] = (1, 2, 3)):
    """For each text, the hashed n-grams it holds and how often. The two NULs behind a text mark its end."""
    points, starts, ends = code_points(texts)
    size = 1 << bits
    hashed = []
    wide = points.astype(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for n in range(1, max(orders) + 1):
        h = h * np.uint64(0x100000001B3) + np.uint64(n)
        h[: len(h) - n + 1] += wide[n - 1 :]
        if n in orders:
            hashed.append(((h * MIX) >> np.uint64(64 - bits)).astype(np.int64))
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        counts = np.zeros(size, np.int64)
        for x in hashed:
            counts += np.bincount(x[s:e], minlength=size)
        at = np.flatnonzero(counts)
        yield at, counts[at]


def word_counts(texts: list[str | None], bits: int, prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)):
    """For each text: hashed whole words and word prefixes and how often, and the number of words. A word is a run of letters."""
    points, starts, ends = code_points(texts)
    is_letter = letters()[points]
    edge = np.diff(is_letter.astype(np.int8), prepend=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    lens = end - begin
    wide = points.astype(np.uint64)
    power = np.uint64(0xD6E8FEB86659FD93)
    # hash of the first k letters, for k up to the longest prefix; whole words by sums of powers
    features, owner = [], []
    doc = np.searchsorted(starts, begin, side="right") - 1
    h = np.zeros(len(begin), np.uint64)
    for k in range(1, max(prefixes, default=0) + 1):
        alive = lens >= k
        h[alive] = (h[alive] + wide[begin[alive] + k - 1] + np.uint64(1)) * power
        if k in prefixes:
            sel = lens > k
            features.append((((h[sel] ^ np.uint64(k)) * MIX) >> np.uint64(64 - bits)).astype(np.int64))
            owner.append(doc[sel])
    powers = np.cumprod(np.full(int(lens.max()) if len(lens) else 0, power, np.uint64))
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    terms = gather(wide, begin, lens) * powers[within]
    sums = np.add.reduceat(terms, np.cumsum(lens) - lens) if len(lens) else np.zeros(0, np.uint64)
    features.append((((sums ^ (lens.astype(np.uint64) << np.uint64(40))) * MIX) >> np.uint64(64 - bits)).astype(np.int64))
    owner.append(doc)
    key = np.concatenate([(o << bits) | f for o, f in zip(owner, features, strict=True)])
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    cut = np.searchsorted(key >> bits, np.arange(len(texts) + 1))
    words = np.bincount(doc, minlength=len(texts))
    for i in range(len(texts)):
        part = slice(cut[i], cut[i + 1])
        yield key[part] & ((1 << bits) - 1), count[part], int(words[i])


def sparse_batch(names: list[str], columns: list[pa.Array], at: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    lists = [pa.array([x.astype(">i4").tobytes() for x in v], pa.binary()) for v in (at, counts)]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*names, "at", "counts"])
