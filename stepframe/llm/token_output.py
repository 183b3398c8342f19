"""Token-id output in a compressed binary format: an adaptive context-mixing range coder over token ids.

Prediction. Of each id, order 2 and order 1 (tables looked up by the last two ids and the last id) name the id that
followed there, with a confidence of 0 to 15; order 0 is how often each id was seen. Whether the id is order 2's
candidate, and if not, whether it is order 1's, is a binary choice. Its chance mixes what the three orders say of that candidate: each
has an adaptive chance for its confidence (order 0: for how often it saw the candidate), and these are added in the logistic domain with weights that
learn online, a set for each way in which the orders agree. An id that neither names is coded by order 0's adaptive counts,
first its upper byte, then its lower byte given the upper. All arithmetic is on integers, so any machine reads
what another wrote.

Blocks. Ids are coded in blocks of at most BLOCK ids. Every block starts from empty models and has its own CRC-32,
so blocks decode independently. The query's coder is java/TokenCoder.java, a JVM function from frame to frame;
BlockCoder below is the same coder written plainly, for reading frames without Spark and for tests.

Format. A frame is "TIDC", then little-endian: version u32, documents u64, ids u64, block size u32, blocks u32; the
doc_ids (i64) and id counts (i64); per block its length in 16-bit words (u32) and CRC-32 of its ids as u32 (u32); the
blocks' words (bytes, an odd one filled up with a zero). The version is 3; a frame with null doc_ids has version 4: behind the id counts, a byte for each
document says whether its doc_id is null (its i64 is then 0). Added to it, 0x100 marks a frame on its way to or from the coder: in
place of table and words stand the plain ids (u32). Frames are rows of Parquet files in the shared folder, in ascending
doc_id order, nulls first.

Defined results: a null or empty text holds the end id only; rows that repeat a doc_id stay next to each other as
documents of their own (ordered by their first LEAD characters, then as read), and so do rows with a null doc_id, which stays null; a text longer than a
frame has a frame of its own; an empty table gives no rows. Ids must be below 65,536, else ValueError (an error of the
job inside one). A damaged frame raises ValueError, or fails the job that reads it.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepframe.llm.arrow_text import chunks
from stepframe.llm.jvm import token_coder
from stepframe.llm.words import default_vocabulary, library_encoder
from stepframe.shared import arrow_rows, materialise

BLOCK, FRAME_IDS = 1 << 16, 1 << 20
END_ID = 2
MAGIC, VERSION, WITH_NULLS, PLAIN = b"TIDC", 3, 4, 0x100
HEAD = struct.Struct("<4sIQQII")
SYMBOLS, STEP, MOST, RATE = 256, 24, 60_000, 6
LEAD = 32
#: Other pieces of texts and runs of letters that a worker remembers, and bytes of texts that it cuts at a time.
PIECES, LETTERS, CUT_BYTES = 100_000, 1_000_000, 4 << 20


def _logistic() -> tuple[list[int], list[int]]:
    """Chances of 12 bits for logits -2047..2047 (256 a unit), and the least logit of each chance."""
    squash = [max(1, int(4096 / (1 + math.exp(-d / 256)))) for d in range(-2047, 2048)]
    stretch: list[int] = []
    for d, p in enumerate(squash):
        stretch += [d - 2047] * (p + 1 - len(stretch))
    return squash, stretch + [2047] * (4096 - len(stretch))


SQUASH, STRETCH = _logistic()


class BlockCoder:
    """Codes (words=None) or decodes one block, an id at a time."""

    def __init__(self, words: bytes | None = None):
        self.first: dict[int, tuple[int, int]] = {}
        self.second: dict[int, tuple[int, int, int]] = {}
        self.seen: dict[int, int] = {}
        self.counts: dict[int, list[int]] = {}
        self.chance: dict[tuple[int, int, int], int] = {}
        self.weight = [[26_214] * 3 for _ in range(5)]
        self.before = self.before_that = 0
        self.low, self.range = 0, 0xFFFFFFFF
        self.source = None if words is None else iter(words)
        self.out = bytearray()
        if words is not None:
            self.code = 0
            for _ in range(4):
                self.code = self.code << 8 | next(self.source, 0)

    def narrow(self, below: int, size: int) -> None:
        self.range = size
        if self.source is not None:
            self.code -= below
        else:
            self.low += below
            if self.low > 0xFFFFFFFF:
                self.low &= 0xFFFFFFFF
                k = len(self.out) - 1
                while self.out[k] == 255:
                    self.out[k] = 0
                    k -= 1
                self.out[k] += 1
        while self.range < 1 << 24:
            self.range <<= 8
            if self.source is not None:
                self.code = self.code << 8 | next(self.source, 0)
            else:
                self.out.append(self.low >> 24)
                self.low = self.low << 8 & 0xFFFFFFFF

    def guess(self, group: int, confidences: tuple[int, int], candidate: int, hit: bool) -> bool:
        """Whether the id is the candidate: the chances that orders 2, 1 and 0 give it are mixed."""
        keys = [(order, group, c) for order, c in zip((2, 1, 0), (*confidences, self.seen.get(candidate, 0).bit_length()), strict=True)]
        said = [self.chance.get(k, 32_768) for k in keys]
        logits, weight = [STRETCH[c >> 4] for c in said], self.weight[group]
        p = SQUASH[max(-2047, min(2047, sum(w * x for w, x in zip(weight, logits, strict=True)) >> 16)) + 2047]
        bound = (self.range >> 12) * p
        yes = hit if self.source is None else self.code < bound
        self.narrow(*((0, bound) if yes else (bound, self.range - bound)))
        error = (4096 * yes - p) * RATE
        for k, x in enumerate(logits):
            weight[k] += (x * error + 32_768) >> 16
        for k, c in zip(keys, said, strict=True):
            self.chance[k] = c + ((65_535 * yes - c) >> 5)
        return yes

    def symbol(self, table: int, s: int) -> int:
        """One byte by the adaptive counts of a table."""
        counts = self.counts.setdefault(table, [1] * SYMBOLS)
        total = sum(counts)
        part = self.range // total
        if self.source is not None:
            left, s = min(self.code // part, total - 1), 0
            while counts[s] <= left:
                left -= counts[s]
                s += 1
        self.narrow(sum(counts[:s]) * part, counts[s] * part)
        counts[s] += STEP
        if total + STEP > MOST:
            counts[:] = [(c + 1) >> 1 for c in counts]
        return s

    def id(self, own: int = -1) -> int:
        """Codes the id `own`, or decodes one; then learns from it."""
        mixed = (self.before * 0x9E3779B1 + self.before_that * 0x85EBCA6B) & 0xFFFFFFFF
        place, check = mixed >> 16, mixed >> 8 & 255
        conf1, id1 = self.first.get(self.before, (0, 0))
        of, conf2, id2 = self.second.get(place, (check, 0, 0))
        if of != check:
            conf2 = 0
        found = -1
        if conf2:
            group = 0 if not conf1 else 1 if id1 == id2 else 2
            if self.guess(group, (conf2, conf1), id2, own == id2):
                found = id2
            elif group == 2 and self.guess(3, (conf2, conf1), id1, own == id1):
                found = id1
        elif conf1 and self.guess(4, (0, conf1), id1, own == id1):
            found = id1
        if found < 0:
            top = self.symbol(-1, own >> 8)
            found = top << 8 | self.symbol(top, own & 255)
        self.first[self.before] = self.learned(conf1, id1, found)
        self.second[place] = (check, *self.learned(conf2, id2, found))
        self.seen[found] = min(255, self.seen.get(found, 0) + 1)
        self.before_that, self.before = self.before, found
        return found

    @staticmethod
    def learned(conf: int, guess: int, found: int) -> tuple[int, int]:
        if conf and guess == found:
            return min(15, conf + 1), guess
        return (conf >> 1, guess) if conf > 1 else (1, found)

    def end(self) -> bytes:
        self.out += self.low.to_bytes(4, "big") + bytes(len(self.out) & 1)
        return bytes(self.out)


def encode_blocks(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded 16-bit words of all blocks one after the other, and the number of words of each. ids: all blocks' ids."""
    parts, at = [], 0
    for n in lens.tolist():
        coder = BlockCoder()
        for x in ids[at : at + n].tolist():
            coder.id(x)
        parts.append(np.frombuffer(coder.end(), "<u2"))
        at += n
    return np.concatenate([np.zeros(0, np.uint16), *parts]), np.array([len(p) for p in parts], np.int64)


def decode_blocks(words: np.ndarray, n_words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ids of all blocks one after the other."""
    ids, at = [], 0
    for w, n in zip(n_words.tolist(), lens.tolist(), strict=True):
        coder = BlockCoder(words[at : at + w].astype("<u2").tobytes())
        ids += [coder.id() for _ in range(n)]
        at += w
    return np.array(ids, np.int32)


def _head(docs: np.ndarray, lens: np.ndarray, n_ids: int, block: int, mark: int = 0) -> bytes:
    nulls = np.ma.getmaskarray(docs)
    version, mask = (WITH_NULLS, nulls.astype(np.uint8).tobytes()) if nulls.any() else (VERSION, b"")
    return b"".join([HEAD.pack(MAGIC, version | mark, len(docs), n_ids, block, -(-n_ids // block)), np.ma.filled(docs, 0).astype("<i8").tobytes(), lens.astype("<i8").tobytes(), mask])


def plain_frame(docs: np.ndarray, lens: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame as the coder takes it; null doc_ids are masked."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("token ids must be below 65,536")
    return _head(docs, lens, len(ids), block, PLAIN) + ids.astype("<u4").tobytes()


def _parsed(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, int, int, int]:
    """doc_ids, id counts, ids, block size, marks and where the head ends."""
    if len(raw) < HEAD.size:
        raise ValueError("token frame: too short")
    magic, version, n_docs, n_ids, block, n_blocks = HEAD.unpack_from(raw)
    if magic != MAGIC or version & 0xFF not in (VERSION, WITH_NULLS) or not block or n_blocks != -(-n_ids // block):
        raise ValueError("token frame: not a frame of this format")
    at = HEAD.size
    mask = n_docs if version & 0xFF == WITH_NULLS else 0
    if len(raw) < at + 16 * n_docs + mask:
        raise ValueError("token frame: too short")
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    lens = np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs)
    if mask:
        docs = np.ma.array(docs, mask=np.frombuffer(raw, np.uint8, mask, at + 16 * n_docs) != 0)
    if int(lens.sum()) != n_ids or (n_docs and lens.min() < 0):
        raise ValueError("token frame: lengths do not agree")
    return docs, lens, n_ids, block, version & PLAIN, at + 16 * n_docs + mask


def plain_ids(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, id counts, ids) of a frame as the coder gives it back."""
    docs, lens, n_ids, _, mark, at = _parsed(raw)
    if not mark or len(raw) != at + 4 * n_ids:
        raise ValueError("token frame: not a plain frame")
    return docs, lens, np.frombuffer(raw, "<u4", n_ids, at)


def write_frames(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int = BLOCK) -> list[bytes]:
    """A frame for each (doc_ids, id counts, ids), by the plainly written coder. Null doc_ids are masked."""
    frames = []
    for docs, lens, ids in groups:
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("token ids must be below 65,536")
        own = np.diff(np.append(np.arange(0, len(ids), block), len(ids)))
        words, counts = encode_blocks(ids, own)
        raw = ids.astype("<u4")
        table = np.empty((len(own), 2), "<u4")
        table[:, 0] = counts
        table[:, 1] = [zlib.crc32(raw[k : k + block].tobytes()) for k in range(0, len(ids), block)]
        frames.append(_head(docs, lens, len(ids), block) + table.tobytes() + words.astype("<u2").tobytes())
    return frames


def read_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, id counts, ids) of each frame, null doc_ids masked, by the plainly written coder; ValueError if one is damaged."""
    out = []
    for raw in frames:
        docs, lens, n_ids, block, mark, at = _parsed(raw)
        own = np.diff(np.append(np.arange(0, n_ids, block), n_ids))
        if mark or len(raw) < at + 8 * len(own):
            raise ValueError("token frame: too short")
        table = np.frombuffer(raw, "<u4", 2 * len(own), at).reshape(-1, 2).astype(np.int64)
        if len(raw) != at + 8 * len(own) + 2 * int(table[:, 0].sum()) or (len(own) and table[:, 0].min() < 2):
            raise ValueError("token frame: lengths do not agree")
        ids = decode_blocks(np.frombuffer(raw, "<u2", -1, at + 8 * len(own)), table[:, 0], own)
        for k, crc in enumerate(table[:, 1].tolist()):
            if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crc:
                raise ValueError(f"token frame: block {k} fails its checksum")
        out.append((docs, lens, ids))
    return out


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode and write all documents; returns the written frames (file_no, frame_no, n_docs, n_ids, payload)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the workers keep their pieces from task to task
        encoder, file_no, frame_no = library_encoder(path, PIECES, LETTERS), TaskContext.get().partitionId(), 0
        doc, lens, ids, held = [], [], [], 0

        def frame() -> pa.RecordBatch:
            plain = plain_frame(np.ma.concatenate(doc), np.concatenate(lens), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (file_no, frame_no, sum(map(len, doc)), held)), pa.array([plain], pa.binary())], names=["file_no", "frame_no", "n_docs", "n_ids", "plain"])

        for b in chunks(batches, limit=CUT_BYTES):
            got, n = encoder.encode(b.column(1))
            inner = np.ones(len(got) + len(n), bool)
            inner[np.cumsum(n + 1) - 1] = False
            own = np.full(len(inner), end_id, np.uint32)
            own[inner] = got
            own_ids = b.column(0)
            doc.append(np.ma.array(own_ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64, mask=own_ids.is_null().to_numpy(zero_copy_only=False)))
            lens.append(n + 1)
            ids.append(own)
            held += len(own)
            if held >= frame_ids:
                yield frame()
                doc, lens, ids, held, frame_no = [], [], [], 0, frame_no + 1
        if doc:
            yield frame()

    # rows of one repeated or null doc_id are dealt by how their texts begin, and equal ones by their place
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keys = ["doc_id", "lead", "place"]
    ordered = own.withColumns({"lead": F.substring("text", 1, LEAD), "place": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    plain = ordered.select("doc_id", "text").mapInArrow(run, "file_no long, frame_no long, n_docs long, n_ids long, plain binary")
    return materialise(plain.select("file_no", "frame_no", "n_docs", "n_ids", token_coder(docs.sparkSession, decode=False)("plain").alias("payload")))


def read_tokens(frames: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of written frames: file_no, frame_no, place in the frame, doc_id, n_tokens, ids_crc32 and (with_ids) ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_no, frame_no, plain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, lens, ids = plain_ids(plain)
                ends = np.cumsum(lens)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(np.full(len(docs), file_no), pa.int64()), pa.array(np.full(len(docs), frame_no), pa.int64()), pa.array(ends - lens, pa.int64()), pa.array(np.ma.getdata(docs), pa.int64(), mask=np.ma.getmaskarray(docs)), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())]
                names = ["file_no", "frame_no", "at", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "file_no long, frame_no long, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    plain = frames.select("file_no", "frame_no", token_coder(frames.sparkSession, decode=True)("payload").alias("plain"))
    return plain.mapInArrow(run, schema)


def frame_starts(frames: DataFrame) -> DataFrame:
    """(file_no, frame_no, base): ids before each frame. One row for each file goes through one window, not each frame."""
    files = frames.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("file_base"))
    within = Window.partitionBy("file_no").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    own = frames.select("file_no", "frame_no", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before"))
    return own.join(files, "file_no").select("file_no", "frame_no", (F.col("file_base") + F.col("before")).alias("base"))


def token_digests(docs: DataFrame, vocabulary: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files written and read back."""
    frames = write_tokens(docs, vocabulary, frame_ids=frame_ids)
    with arrow_rows(docs.sparkSession, 4):  # frames in Python at a time
        digests = materialise(read_tokens(frames, with_ids=False))
    return digests.join(frame_starts(frames), ["file_no", "frame_no"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of frames that lie as Parquet files under path."""
    return read_tokens(spark.read.parquet(path))
