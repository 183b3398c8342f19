"""Packing documents into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of each document is placed by
best-fit decreasing: lengths in falling order, each into the open window with the least room that still holds it.
Open windows hang in a segment tree over remaining capacity (a leaf for each possible room, holding a stack of the
windows with just that room; inner nodes count windows), so the tightest fit is one walk down the tree.

At scale the remainders are dealt by a hash of their row to shards of about SHARD_PIECES, whatever the doc_ids, and every shard packs alone: a shard's
size does not grow with the corpus, and a shard of that size already packs to well under one percent of padding.

Defined results: a null or empty text is one piece that holds the end id only; equal lengths are placed in
ascending order of doc_id, nulls first; rows that repeat a doc_id, and rows without one, are packed as documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepframe.llm.arrow_text import chunks
from stepframe.llm.words import default_vocabulary, library_encoder
from stepframe.shared import kept, materialise

WINDOW, END_ID, SHARD_PIECES, SHARD_BLOCK = 4096, 2, 16_384, 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows by remaining capacity, 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need of an open window, or -1."""
        node, count = need + self.leaves, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def take(self, room: int) -> int:
        node = room + self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each length, and the number of windows; equal lengths keep their order."""
    tree = CapacityTree(capacity)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            w, room = opened, capacity
            opened += 1
        else:
            w = tree.take(room)
        window[i], offset[i] = w, capacity - room
        if room > need:
            tree.add(room - need, w)
    return window, offset, opened


def cut_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most `window` ids: full windows first, then what is left of each document."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for b in chunks(batches):
            ids, lens = encoder.encode(b.column(1).to_pylist())
            doc, start, length, crc, total = [], [], [], [], []
            at = 0
            for doc_id, n in zip(b.column(0).to_pylist(), lens.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for s in range(0, n + 1, window):
                    piece = own[s : s + window]
                    doc.append(doc_id)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)


def dealt(rest: DataFrame, shards: int) -> DataFrame:
    """rest with its shard. The row's place counts too, so that rows of one repeated or null doc_id, even with one text, are spread."""
    return rest.withColumn("at", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "at"), F.lit(shards)).cast("long")).drop("at")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset. Sequence ids are gapless: full windows first, then shard after shard."""
    return kept(lambda: _pack(docs, window, end_id, vocabulary, shard_pieces), docs.sparkSession)


def _pack(docs: DataFrame, window: int, end_id: int, vocabulary: str | None, shard_pieces: int) -> DataFrame:
    pieces = materialise(cut_documents(docs, window, end_id, vocabulary))
    spark = pieces.sparkSession
    full, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_pieces))

    def place(shard: pa.Table) -> pa.Table:
        # Arrow keeps null and large doc_ids as they are
        doc, start, crc = (shard.column(c) for c in ("doc_id", "start", "ids_crc32"))
        null = doc.is_null().to_numpy()
        order = np.lexsort((crc.to_numpy(), start.to_numpy(), doc.fill_null(0).to_numpy(), ~null))
        shard = shard.take(pa.array(order))
        local, offset, _ = best_fit_decreasing(shard.column("length").to_numpy(), window)
        return shard.append_column("local", pa.array(local)).append_column("offset", pa.array(offset))

    placed = dealt(rest, shards).groupBy("shard").applyInArrow(place, f"{PIECES}, shard long, local long, offset long")
    whole = full.select(*full.columns, F.lit(-1).cast("long").alias("shard"), F.monotonically_increasing_id().alias("local"), F.lit(0).cast("long").alias("offset"))
    # a full window's run is the partition it was read in, whose rows monotonically_increasing_id counts from 0
    run, within = F.shiftright("local", 33), F.col("local").bitwiseAND((1 << 33) - 1)
    placed = materialise(whole.select(*full.columns, (-1 - run).alias("shard"), within.alias("local"), "offset").unionByName(placed), spark)
    bases = _running(placed.groupBy("shard").agg((F.max("local") + 1).alias("n")))
    return placed.join(bases, "shard").select(*full.columns, (F.col("base") + F.col("local")).alias("sequence_id"), "offset")


def _running(sizes: DataFrame) -> DataFrame:
    """(shard, base): windows in the shards before each. One row for each SHARD_BLOCK shards goes through one window."""
    sizes = materialise(sizes.withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("first"))
    inner = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("shard"))), F.lit(0)).alias("inner"))
    return inner.join(blocks, "block").select("shard", (F.col("first") + F.col("inner")).alias("base"))


def sequences(docs: DataFrame, packed: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids array<int>): the packed windows themselves, unpadded. Needs distinct doc_ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for b in chunks(batches):
            ids, lens = encoder.encode(b.column(1).to_pylist())
            own = [np.append(x, end_id).astype(np.int32) for x in np.split(ids, np.cumsum(lens)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
    part = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    # a sequence holds at most `window` ids, so its pieces are bounded
    return part.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
