"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension: whether the component is positive. A code is cut into substrings of 16
bits, each with a hash table of its own (offsets into an order of the rows). A query probes the tables in turn with
all substrings at distance r = 0, 1, 2, ... of its own; once table a has been probed with radius r, every code within
Hamming distance m * r + a (m tables) has been seen. The search stops when the k-th verified distance is covered.

Rows lie in shards of about SHARD_ROWS by hash. A shard's index is built once, and all blocks of the stated query set
stream through it. The first shard is searched alone: the k-th distance found there bounds each query's search in the
other shards, which return only rows within it, at most k each.

Defined results: neighbours are ordered by distance, then id, and never include the query's own row; with fewer than
k other rows, all of them; a null vector or id has no code (it is neither query nor found); null or NaN components
count as not positive; shorter vectors are padded with zeros; rows that repeat an id are found, and asked for, as rows
of their own, so that each has k neighbours, the other rows of its id among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepframe.shared import arrow_rows, kept, materialise

SUB = 16
SHARD_ROWS, QUERY_ROWS = 65_536, 1024
NO_BOUND = 1 << 30

_SORTED = np.argsort(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)), kind="stable").astype(np.uint32)
_EDGES = np.searchsorted(np.bitwise_count(_SORTED), np.arange(SUB + 2))


def masks(weight: int) -> np.ndarray:
    return _SORTED[_EDGES[weight] : _EDGES[weight + 1]]


class MultiIndex:
    """Hash tables of the 16-bit substrings of n codes (n, words of 16 bits)."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None):
        self.codes, self.ids, self.m = codes, ids, codes.shape[1]
        self.rows = ids if rows is None else rows
        self.order, self.offset = [], []
        for a in range(self.m):
            self.order.append(np.argsort(codes[:, a], kind="stable"))
            self.offset.append(np.append(0, np.cumsum(np.bincount(codes[:, a], minlength=1 << SUB))))

    def bucket_rows(self, a: int, values: np.ndarray) -> np.ndarray:
        start, stop = self.offset[a][values], self.offset[a][values.astype(np.int64) + 1]
        hit = np.flatnonzero(stop > start)
        if not len(hit):
            return np.zeros(0, np.int64)
        start, n = start[hit], stop[hit] - start[hit]
        ends = np.cumsum(n)
        return self.order[a][np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]))]

    def search(self, code: np.ndarray, own: int, k: int, best: list[tuple[int, int]], bound: int = NO_BOUND) -> list[tuple[int, int]]:
        """The k least (distance, id) among `best` and the rows here but `own` that lie within `bound`."""
        if not len(self.ids):
            return best
        seen = np.zeros(len(self.ids), bool)
        for radius in range(SUB + 1):
            flips = masks(radius)
            for a in range(self.m):
                rows = self.bucket_rows(a, flips ^ code[a])
                rows = rows[~seen[rows]]
                if len(rows):
                    seen[rows] = True
                    rows = rows[self.rows[rows] != own]
                    d = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
                    near = d <= (min(bound, best[-1][0]) if len(best) >= k else bound)
                    d, rows = d[near], rows[near]
                    if len(rows) > k:
                        first = np.lexsort((self.ids[rows], d))[:k]
                        d, rows = d[first], rows[first]
                    best = sorted([*best, *zip(d.tolist(), self.ids[rows].tolist(), strict=True)])[:k]
                if (min(bound, best[-1][0]) if len(best) == k else bound) <= self.m * radius + a:
                    return best
        return best


def codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, code binary): the bits of each vector as 16-bit words, all codes of one length."""
    v = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("v")).where("id is not null and v is not null")
    longest = v.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-longest // SUB) * SUB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lens = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(len(lens)) * width - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            bits = np.zeros(len(lens) * width, bool)
            bits[at] = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False) > 0
            words = np.packbits(bits.reshape(len(lens), width), axis=1).view(">u2").astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.tobytes() for w in words], pa.binary())], names=["id", "code"])

    return v.mapInArrow(run, "id long, code binary")


def _packed(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """Rows (row, id, code, bound) dealt to n bins of `kind`, a line each: (kind, rows, ids, codes, bounds)."""

    def run(t: pa.Table) -> pa.Table:
        raw = [pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for c in ("row", "id", "bound")]
        return pa.table([t.column(kind)[:1], raw[0], raw[1], pa.array([b"".join(t.column("code").to_pylist())], pa.binary()), raw[2]], names=[kind, "rows", "ids", "codes", "bounds"])

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("long").alias(kind), "row", "id", "code", "bound")
    return dealt.groupBy(kind).applyInArrow(run, f"{kind} long, rows binary, ids binary, codes binary, bounds binary")


def _search(shards: DataFrame, first: int, last: int, blocks: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, id, distance): the k nearest rows of each shard first..last, within its bound, for every query."""
    shard = shards.where(F.col("shard").between(first, last)).select("shard", F.lit(-1).cast("long").alias("block"), "rows", "ids", "codes", "bounds")
    # every block of the stated query set visits every shard
    asked = blocks.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("shard"), *shard.columns[1:])
    lines = shard.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for b in batches:
            for line in b.to_pylist():
                rows, ids = np.frombuffer(line["rows"], np.int64), np.frombuffer(line["ids"], np.int64)
                code = np.frombuffer(line["codes"], np.uint16).reshape(len(ids), -1)
                if line["block"] < 0:
                    index, of = MultiIndex(code, ids, rows), line["shard"]
                    continue
                assert of == line["shard"]
                found = []
                for j, (row, bound) in enumerate(zip(rows.tolist(), np.frombuffer(line["bounds"], np.int64).tolist(), strict=True)):
                    found += [(row, ids[j], i, d) for d, i in index.search(code[j], row, k, [], bound)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 4)], names=["query_row", "query_id", "id", "distance"])

    with arrow_rows(shards.sparkSession, 4):
        return materialise(lines.mapInArrow(run, "query_row long, query_id long, id long, distance long"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of every row whose id is divisible by `every`."""
    return kept(lambda: _top_k(vectors, k, every, id_column, vector_column, shard_rows), vectors.sparkSession)


def _top_k(vectors: DataFrame, k: int, every: int, id_column: str, vector_column: str, shard_rows: int) -> DataFrame:
    coded = materialise(codes(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()))
    coded = coded.withColumn("bound", F.lit(NO_BOUND).cast("long"))
    n = max(1, -(-coded.count() // shard_rows))
    shards = materialise(_packed(coded, "shard", n))
    queries = coded.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    found = _search(shards, 0, 0, materialise(_packed(queries, "block", blocks)), k)
    if n > 1:
        bounds = found.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.max("distance")).alias("known"))
        bounded = queries.join(bounds, "row", "left").select("row", "id", "code", F.coalesce("known", "bound").alias("bound"))
        found = found.unionByName(_search(shards, 1, n - 1, materialise(_packed(bounded, "block", blocks)), k))
    # at most k rows of each shard meet here
    place = Window.partitionBy("query_row").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "distance")
