"""Texts cut at single blanks and line feeds, each distinct piece encoded once.

Both separators are white space to every tokenizer used here, so no token and no normalisation step crosses them:
encoding the pieces and joining the ids equals encoding the whole text (tests compare the two).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stepframe.llm.arrow_text import gather, text_buffers


class _Codes(dict):
    """piece -> dense code; unseen pieces get the next code and are listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code


class PieceEncoder:
    """Encodes texts through `encode(list of pieces) -> list of id lists`, remembering at most about `most` pieces."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode_pieces, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def release(self) -> None:
        """Forgets all pieces: called at the end of a task, so that idle workers hold no memory."""
        self._clear()

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        ids, lens = self.encode_pieces(fresh)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.known, self.known + len(lens))
        self.lens[at] = lens
        self.starts[at] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.known += len(lens)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has; None counts as an empty text."""
        if len(self.codes) > self.most:
            self._clear()
        per_text, parts = np.zeros(len(texts), np.int64), []
        look = self.codes.__getitem__
        for i, text in enumerate(texts):
            pieces = (text or "").replace("\n", " ").split(" ")
            per_text[i] = len(pieces)
            parts.append(np.fromiter(map(look, pieces), np.int64, len(pieces)))
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self._learn()
        lens = self.lens[codes]
        ids = gather(self.flat, self.starts[codes], lens)
        ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = ends[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)


def as_numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def strings(raw: np.ndarray | bytes, lengths: np.ndarray) -> pa.Array:
    """Strings of these lengths whose bytes lie one after the other."""
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(raw))


def numbers(codes: _Codes, pieces: pa.Array) -> np.ndarray:
    """The code of each piece, as codes[piece] gives it."""
    pieces = pieces.dictionary_encode()
    distinct = as_numpy(pieces.dictionary)
    own = np.fromiter(map(codes.get, distinct, repeat(-1)), np.int64, len(distinct))
    new = np.flatnonzero(own < 0)
    fresh = distinct[new].tolist()
    own[new] = np.arange(len(codes), len(codes) + len(fresh))
    codes.update(zip(fresh, own[new].tolist(), strict=True))
    codes.fresh += fresh
    return own[as_numpy(pieces.indices)]


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each piece, the distinct pieces with a blank at the end of each, and how many pieces each text has."""
    raw, offs = text_buffers(texts)
    bounds, view = offs.tolist(), memoryview(raw)
    joined = b" ".join([*(view[s:e] for s, e in zip(bounds, bounds[1:], strict=False)), b""]).replace(b"\n", b" ")
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    pieces = strings(joined, np.diff(ends, prepend=0)).dictionary_encode()
    # each text's last blank is one that was added
    last = np.searchsorted(ends, offs[1:] + np.arange(1, len(offs))) + 1
    return as_numpy(pieces.indices), pieces.dictionary, np.diff(last, prepend=0)


#: Marks that stand alone behind a run of letters for this pre-tokenizer and never compose with a letter.
TAIL = ".,;:!?%&$*#"
#: The one letter whose lower case ends in a mark, which would join a tail; so do some letters that NFC takes apart.
DOTTED = "\u0130"


class LibraryEncoder:
    """The tokenizers library behind two PieceEncoders.

    Texts are cut and their distinct pieces found by Arrow. A piece of letters followed by marks of TAIL is two
    pre-tokens, so its letters are encoded once for all their tails and remembered without them. Runs of letters go to
    the library many at a time, joined by blanks; each is one pre-token, which ends in the only token with the
    end-of-word suffix. Where the count of those tokens differs, each piece goes alone.
    """

    JOINED = 500

    def __init__(self, path: str, most: int = 100_000, most_letters: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        suffix = self.tok.model.end_of_word_suffix
        self.ends = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.letters = PieceEncoder(self._encode_letters, most_letters)
        self.tails = PieceEncoder(self._encode_alone, most)

    def release(self) -> None:
        for part in (self.letters, self.tails):
            part._clear()

    def _encode_alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.int64, int(lens.sum())), lens

    def _encode_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [], []
        for k in range(0, len(pieces), self.JOINED):
            part = pieces[k : k + self.JOINED]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and len(ids) and last[-1] == len(ids) - 1:
                n = np.diff(last, prepend=-1)
            else:
                ids, n = self._encode_alone(part)
            flat.append(ids)
            lens.append(n)
        return np.concatenate(flat), np.concatenate(lens)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has; None counts as an empty text."""
        codes, distinct, per_text = cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        flat, starts, lens = self._encode_distinct(distinct)
        n = lens[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return gather(flat, starts[codes], n), np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece start and how many they are. Each piece has a blank at its end."""
        for inner in (self.letters, self.tails):
            if len(inner.codes) > inner.most:
                inner._clear()
        base = pc.ascii_rtrim(pieces, characters=TAIL + " ")
        alpha, wide = as_numpy(pc.ascii_is_alpha(base)).copy(), ~as_numpy(pc.string_is_ascii(base))
        others = base.filter(pa.array(wide))
        composed = np.fromiter((is_normalized("NFC", x) for x in as_numpy(others)), bool, len(others))
        alpha[wide] = as_numpy(pc.utf8_is_alpha(others)) & composed & ~as_numpy(pc.match_substring(others, DOTTED))
        runs = pc.if_else(pa.array(wide), base, pc.ascii_lower(base)).filter(pa.array(alpha))
        raw, offs = text_buffers(pieces)
        begin = offs[:-1] + np.where(alpha, as_numpy(pc.binary_length(base)), 0)
        length = offs[1:] - 1 - begin
        behind = ~alpha | (length > 0)
        rest = strings(gather(raw, begin[behind], length[behind]), length[behind])
        heads, tails = np.full(len(pieces), -1), np.full(len(pieces), -1)
        heads[alpha], tails[behind] = numbers(self.letters.codes, runs), numbers(self.tails.codes, rest)
        for inner in (self.letters, self.tails):
            inner._learn()
        starts, lens = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        for side, (inner, codes) in enumerate(((self.letters, heads), (self.tails, tails))):
            has = codes >= 0
            lens[has, side] = inner.lens[codes[has]]
            starts[has, side] = inner.starts[codes[has]] + side * self.letters.used
        both = np.concatenate([self.letters.flat[: self.letters.used], self.tails.flat[: self.tails.used]])
        own = lens.sum(1)
        return gather(both, starts.ravel(), lens.ravel()), np.cumsum(own) - own, own


_LIBRARY: dict[tuple, LibraryEncoder] = {}


def library_encoder(path: str, *most: int) -> LibraryEncoder:
    """One encoder for each process, vocabulary file and number of remembered pieces."""
    if (path, *most) not in _LIBRARY:
        _LIBRARY[path, *most] = LibraryEncoder(path, *most)
    return _LIBRARY[path, *most]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
