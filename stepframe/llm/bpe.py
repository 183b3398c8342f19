"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up every adjacent pair by binary search over the
sorted pair keys (left id * vocabulary size + right id), takes the lowest rank in each word, and merges all
occurrences of that pair at once, left to right. Words without a mergeable pair leave the array.

Defined results: a null or empty text has no ids and decodes to ''; repeated and tied texts get equal results; the
two special tokens of the vocabulary are recognised where their exact string stands in a text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stepframe.llm.arrow_text import chunks
from stepframe.llm.words import PieceEncoder, default_vocabulary

NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """A byte-level BPE with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.spaces = regex.compile(r"\p{White_Space}+")
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.number = [str(i) for i in range(self.size)]
        self.pieces = PieceEncoder(self._encode_pieces)

    def normalise(self, text: str) -> str:
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; NONE where there is no such merge or the word ends."""
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.rank[at[hit]]
        return rank

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words and the word of each; `word` is ascending."""
        done_sym, done_word = [], []
        while len(sym):
            rank = self._ranks(sym, word)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(sym))))
            live = best != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, best = sym[live], word[live], rank[live], best[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # within a run of overlapping occurrences (as in aaa) every other one merges, from the left
            run = np.cumsum(np.concatenate([[True], np.diff(hit) != 1]))
            lead = hit[np.concatenate([[True], np.diff(run) != 0])]
            hit = hit[(hit - lead[run - 1]) % 2 == 0]
            sym = sym.copy()
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, ends, owner, fixed = [], [], [], []
        for i, piece in enumerate(pieces):
            for part in self.split_special.split(piece) if self.split_special and "<" in piece else (piece,):
                if part in self.special:
                    fixed.append((len(ends), self.special[part]))
                    data.append(b" ")
                    ends.append(1)
                    owner.append(i)
                elif part:
                    for w in self.words.findall(self.normalise(part)):
                        raw = w.encode("utf-8")
                        data.append(raw)
                        ends.append(len(raw))
                        owner.append(i)
        lens = np.array(ends, np.int64)
        if not len(lens):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(lens) - 1
        sym[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(lens)), lens)
        sym, word = self.merge(sym, word)
        if fixed:
            at = np.array([a for a, _ in fixed])
            sym[np.searchsorted(word, at)] = [x for _, x in fixed]
        counts = np.bincount(word, minlength=len(lens))
        return sym, np.bincount(np.array(owner), weights=counts, minlength=len(pieces)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, lens = self.pieces.encode(texts)
        return np.split(ids, np.cumsum(lens)[:-1]) if len(lens) else []

    def decode(self, ids) -> str:
        """The tokens joined by blanks: this vocabulary names no decoder, so ends of words stay visible."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in chunks(batches):
            ids = bpe.encode(b.column(1).to_pylist())
            decoded = [bpe.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_column)


def bpe_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same ids and texts as bpe_encode, hashed where they are made."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in chunks(batches):
            n, of_ids, of_text = [], [], []
            for ids in bpe.encode(b.column(1).to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(bpe.number.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.pieces.release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
