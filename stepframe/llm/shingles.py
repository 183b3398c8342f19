"""Word shingle sets of whole texts, as sorted unique 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stepframe.llm.arrow_text import gather, text_buffers

_RNG = np.random.default_rng(20240501)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
STEP, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of one stretch of bytes."""
    space = SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    lens = end - begin
    letters = BYTE[raw[~space]]
    starts = np.cumsum(lens) - lens
    within = np.arange(len(letters), dtype=np.int64) - np.repeat(starts, lens)
    power = np.cumprod(np.full(int(lens.max()), STEP, np.uint64))
    letters *= power[within]
    return mix(np.add.reduceat(letters, starts) + lens.astype(np.uint64)), begin


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The distinct `words`-word shingles of each text; fewer words make one shingle, none an empty set."""
    raw, offs = text_buffers(column)
    parts, at = [], 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        if stop < len(raw):
            # cut at white space or a row's end, so that no word is torn
            gaps = np.flatnonzero(SPACE[raw[at:stop]])
            rows = offs[np.searchsorted(offs, at, side="right") : np.searchsorted(offs, stop, side="right")]
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(rows[-1]) if len(rows) else 0)
            if cut > at:
                stop = cut
            else:
                later = np.flatnonzero(SPACE[raw[stop : int(offs[np.searchsorted(offs, at, side="right")])]])
                stop = stop + int(later[0]) if len(later) else int(offs[np.searchsorted(offs, at, side="right")])
        inner = offs[(offs > at) & (offs < stop)]
        # words also end where a row ends
        piece = raw[at:stop]
        if len(inner):
            ends = np.zeros(len(piece) + len(inner), np.uint8)
            where = inner - at + np.arange(len(inner))
            ends[where] = 0x20
            keep = np.ones(len(ends), bool)
            keep[where] = False
            ends[keep] = piece
            h, begin = word_hashes(ends)
            begin = begin - np.searchsorted(where, begin)
        else:
            h, begin = word_hashes(piece)
        parts.append((h, begin + at))
        at = stop
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    begin = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    cut = np.searchsorted(begin, offs)
    counts = np.diff(cut)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * PLACE + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, n in zip(cut[:-1].tolist(), counts.tolist(), strict=True):
        if n >= words:
            own = np.sort(rolled[a : a + n - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            x = np.uint64(n)
            for w in h[a : a + n]:
                x = np.uint64((int(x) * int(PLACE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        total = mix(s * PLACE + np.uint64(1)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted unique arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


__all__ = ["common", "gather", "mix", "set_key", "shingle_sets"]
