"""N-gram Jaccard join by a token-group matrix, exact: every pair of similar texts is linked.

1. Classes. Equal shingle sets are one class; a class stands for all its copies from here on.
2. Groups. Classes that agree in a band of MinHash values are checked against one leader of their band key (a star,
   never all pairs): the class that shares its band keys with most others, as the common origin of copies does.
   Verified links joined into components are the groups; most classes are groups alone.
3. Token-group matrix. Tokens are ordered from rare to frequent by a fixed-size count sketch over all documents, and
   behind all others come those that several documents of a hash sample hold, by their exact counts there: in a large
   table most cells of the sketch count alike (any total order is right; a good one is fast). Two sets with Jaccard >= t must share one of the first
   n - ceil(t * n) + 1 tokens of each in that order, and a known number of those. The matrix stores each group's union
   of such tokens of its members, with their least and greatest size. A query set's overlap with a group is at most the number of its tokens
   in that union; only groups where this bound reaches what the sizes ask for qualify. Where one member alone holds the shared tokens, the
   bound is that pair's own; else the group is opened and its members are counted one by one.
4. Frequent tokens. Sets that share a token of many sets' prefixes are in one cluster. Their groups, whole or (large ones) in
   parts, lie in blocks with unions of all their tokens, and blocks of like sizes meet: each query set's overlap with every group's union is
   counted, and only qualifying groups that no link joins yet are opened. Blocks are sent to squares of CELL_BLOCKS by CELL_BLOCKS
   meetings, so a block is copied once for so many others, not once for each.
   Before that, where the clusters hold many tokens, step 3 is done again for their sets alone, in an order that has the
   tokens just found frequent, with their exact counts, behind the others: any order that all sets of a round share is
   right, and every pair that shares a frequent token is a pair of the next round. Most sets leave the clusters so.
5. Pairs of opened groups are verified on the whole texts; all links together give the components.

Defined results: a null, empty or blank text has no shingle and links with nothing (its component is itself); rows
that repeat a doc_id are documents of their own; rows without a doc_id get the component of their copies, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.arrow_text import chunks, ranges
from stepframe.llm.components import components
from stepframe.llm.shingles import common, mix, set_key, shingle_sets
from stepframe.shared import arrow_rows, kept, materialise

WORDS, PERCENT = 5, 80
BANDS, ROWS = 8, 3
SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
#: One document in SAMPLED has its tokens counted exactly, in so many parts; at most LISTED of a part's tokens are listed as frequent.
SAMPLED, SAMPLE_PARTS, LISTED = 16, 64, 1 << 14
#: Sampled tokens that a scanning task holds.
HELD_TOKENS = 1 << 20
#: A lookup table of at most this many rows is broadcast in the JVM, one of at most LOOKUP_ROWS as sorted arrays (16 bytes a row) for Python workers;
#: a larger one is joined by shuffle, which writes all texts once more.
BROADCAST_ROWS, LOOKUP_ROWS = 500_000, 1 << 22
#: Keys that a task remembers, so as to send a class once.
SEEN_KEYS = 1 << 16
#: Sets of clusters with more tokens than this go through the matrix again in a better order, so many times at most, as long as half of them leave; tokens then listed.
ROUND_TOKENS, ROUNDS, FOUND_TOKENS = 1_000_000, 4, 1 << 20
BUCKET_TOKENS = 250_000
#: The rows of a token that is in more sets than this are dealt by set, not by token.
SPREAD_SETS = 10_000
#: A token in more prefixes than this is handled by blocks of about BLOCK_TOKENS tokens and at most some BLOCK_SETS sets.
HOT_CLASSES, BLOCK_TOKENS, BLOCK_SETS = 16, 20_000, 2_000
#: Blocks on each side of a square of meetings, which one task holds.
CELL_BLOCKS = 16
#: Cells of a count matrix in a Python worker; pairs that one copy of a leader's text serves.
CELLS, LED_PAIRS = 4_000_000, 500
#: Texts (bytes) that a Python worker turns into arrays at a time, and rows of an Arrow batch.
SCAN_BYTES, ARROW_ROWS = 1 << 20, 2000

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(s: np.ndarray) -> list[int]:
    """One key for each band of MinHash values."""
    least = np.array([((s ^ (a >> np.uint64(7))) * a).min() for a in _SEEDS]).reshape(BANDS, ROWS)
    h = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        h = mix(h + least[:, k])
    return h.view(np.int64).tolist()


def prefix_length(n, percent: int = PERCENT):
    """Of a number or a column."""
    least = F.floor((percent * n + 99) / 100) if isinstance(n, Column) else (percent * n + 99) // 100
    return n - least + 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _arrays(table: DataFrame, *columns: str) -> list[np.ndarray]:
    """Long columns without nulls as arrays, in ascending order of the first."""
    found = table.select(*columns).toArrow()
    arrays = [np.concatenate([x.to_numpy() for x in c.chunks]) if c.num_chunks else np.zeros(0, np.int64) for c in found.columns]
    by = np.argsort(arrays[0], kind="stable")
    return [a[by] for a in arrays]


def keyed_texts(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(key, text) of the rows of docs (doc_id, text) for each of the `rows` rows of wanted (doc_id, key) with their doc_id."""
    if rows <= BROADCAST_ROWS or rows > LOOKUP_ROWS:
        return docs.join(_small(wanted, rows), "doc_id").select("key", "text")
    held = docs.sparkSession.sparkContext.broadcast(_arrays(wanted, "doc_id", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys = held.value
        for b in batches:
            own = b.column(0).fill_null(0).to_numpy()
            first = np.searchsorted(ids, own)
            n = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(ids, own, side="right") - first)
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.repeat(first, n) + ranges(n)]), b.column(1).take(pa.array(np.repeat(np.arange(len(n)), n)))], names=["key", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, text string")


def without(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """docs without the rows whose doc_id is one of the `rows` ids; nulls stay."""
    if rows <= BROADCAST_ROWS or rows > LOOKUP_ROWS or docs.schema["doc_id"].dataType.typeName() != "long":
        return docs.join(_small(ids, rows), "doc_id", "left_anti").select(docs.columns)
    held, at = docs.sparkSession.sparkContext.broadcast(_arrays(ids, "doc_id")[0]), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(at)
            gone = np.isin(own.fill_null(0).to_numpy(), held.value) & own.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(~gone))

    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return materialise(docs.mapInArrow(run, docs.schema))


def scan(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document (doc_id, n, key, bands), the partial sketches (chunk, counts) and the sampled tokens (-1 - part, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "key", "bands", "chunk", "counts"]
        held, n_held = [], 0

        def partial(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
            m = len(parts)
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

        def sampled() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            cut = np.searchsorted(tokens, np.arange(SAMPLE_PARTS, dtype=np.uint64) * np.uint64((1 << 64) // SAMPLE_PARTS))
            return partial([(-1 - k, x.tobytes()) for k, x in enumerate(np.split(tokens, cut[1:])) if len(x)])

        for b in chunks(batches, limit=SCAN_BYTES):
            sets = shingle_sets(b.column(1), words)
            tokens = np.concatenate(sets)
            if len(tokens):
                sketch += np.bincount((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
            m = len(sets)
            keys = [set_key(s) for s in sets]
            chosen = [s for s, key in zip(sets, keys, strict=True) if key % SAMPLED == 0 and len(s)]
            held += chosen
            n_held += sum(map(len, chosen))
            if n_held > HELD_TOKENS:
                yield sampled()
                held, n_held = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        yield sampled()
        yield partial([(k, c.tobytes()) for k, c in enumerate(sketch.reshape(-1, SKETCH_CHUNK)) if c.any()])

    return docs.mapInArrow(run, "doc_id long, n long, key long, bands array<long>, chunk int, counts binary")


def sum_sketch(partial: DataFrame) -> np.ndarray:
    """The count sketch over all documents: 2^SKETCH_BITS numbers, however large the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 0x7FFFFFFF).astype(np.int32).tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    sketch = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, np.int32).reshape(-1, SKETCH_CHUNK)
    for r in partial.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():
        sketch[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return sketch.reshape(-1)


def sampled_counts(partial: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, ascending, that two or more sampled documents hold and in how many; SAMPLE_PARTS * LISTED of them at most, the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(k, []).append(np.frombuffer(raw, np.uint64))
        for k in list(own):
            tokens, counts = np.unique(np.concatenate(own.pop(k)), return_counts=True)
            top = np.flatnonzero(counts > 1)
            top = np.sort(top[np.argsort(-counts[top], kind="stable")[:LISTED]])
            cols = [pa.array([tokens[top].tobytes()], pa.binary()), pa.array([np.minimum(counts[top], 0x7FFFFFFF).astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["tokens", "counts"])

    rows = partial.repartition("chunk").mapInArrow(run, "tokens binary, counts binary").collect()
    tokens, counts = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) if rows else np.zeros(0, kind) for c, kind in (("tokens", np.uint64), ("counts", np.int32)))
    by = np.argsort(tokens)
    return tokens[by], counts[by]


class Order:
    """The order of tokens, of a fixed size: cells of the sketch, and behind them the tokens listed as frequent."""

    def __init__(self, sketch: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        self.sketch, self.tokens, self.counts = sketch, tokens, counts
        self.listed = np.zeros(len(sketch), bool)
        self.listed[self._cells(tokens)] = True

    def _cells(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)

    def sampled(self, tokens: np.ndarray) -> np.ndarray:
        """How many sampled documents hold each token; 0 of a token that is not listed."""
        out = np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            maybe = np.flatnonzero(self.listed[self._cells(tokens)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[maybe]
            out[maybe[hit]] = self.counts[at[hit]]
        return out

    def ranks(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that ascend from rare to frequent tokens, and which tokens are in more than about SPREAD_SETS sets."""
        seen = self.sampled(tokens)
        return self.sketch[self._cells(tokens)] + (seen << 32), seen * SAMPLED > SPREAD_SETS

    def behind(self, tokens: np.ndarray, prefixes: np.ndarray) -> Order:
        """The order with these tokens, which so many prefixes hold, among the listed ones: about a fifth of a set is its prefix."""
        tokens, counts = np.concatenate([self.tokens, tokens]), np.concatenate([self.counts, np.minimum(1 + prefixes * 5 // SAMPLED, 0x7FFFFFFF).astype(np.int32)])
        by = np.lexsort((counts, tokens))
        last = np.append(tokens[by][1:] != tokens[by][:-1], True)
        return Order(self.sketch, tokens[by][last], counts[by][last])


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of class keys, those that link: (a, b, shared, united), from the whole texts.

    The text of `a` goes once to every LED_PAIRS of its pairs, which stream past it.
    """
    wanted = materialise(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", F.col("rep").alias("doc_id")))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        texts = materialise(keyed_texts(docs, wanted, wanted.count()))
    leads = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / LED_PAIRS).alias("parts")))
    led = pairs.join(leads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("long").alias("part"), "b").join(texts.withColumnRenamed("key", "b"), "b")
    lead = leads.join(texts.withColumnRenamed("key", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    lines = lead.unionByName(led.select("a", "part", "b", "text")).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first = None, np.zeros(0, np.uint64)
        for block in chunks(batches, limit=SCAN_BYTES):
            rows = []
            for a, b, s in zip(block.column(0).to_pylist(), block.column(2).to_pylist(), shingle_sets(block.column(3), words), strict=True):
                # a repeated doc_id may bring another text along: the keys tell
                if set_key(s) != (a if b is None else b):
                    continue
                if b is None:
                    of, first = a, s
                elif of == a:
                    shared = common(first, s)
                    united = len(first) + len(s) - shared
                    if 100 * shared >= percent * united:
                        rows.append((a, b, shared, united))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "united"])

    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return materialise(lines.mapInArrow(run, "a long, b long, shared long, united long").distinct())


def star_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): each class with the leader of each of its band keys."""
    keyed = materialise(reps.select("key", F.posexplode("bands").alias("band", "value")))
    shared = materialise(keyed.groupBy("band", "value").agg(F.count("*").alias("m")).where("m > 1"))
    keyed = materialise(keyed.join(shared, ["band", "value"]))
    degree = materialise(keyed.groupBy("key").agg(F.sum("m").alias("degree")))
    keyed = materialise(keyed.drop("m").join(degree, "key"))
    leaders = materialise(keyed.groupBy("band", "value").agg(F.max(F.struct("degree", "key")).alias("top")).select("band", "value", F.col("top.key").alias("a")))
    return materialise(keyed.join(leaders, ["band", "value"]).where("a <> key").select("a", F.col("key").alias("b")).distinct())


def prefixes(texts: DataFrame, owners: Broadcast, shared: Broadcast, buckets: int, words: int, percent: int) -> DataFrame:
    """(bucket, tokens, keys, owners, sizes): packed rows of the token-group matrix, dealt by token hash, and by class too where a token is frequent.

    texts: (key, owner, text). Without a key every text counts; a class without an owner has that of the lookup `owners`
    (keys, owners), or is a group alone. A class may come several times, at most once in SEEN_KEYS keys of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known, own = owners.value
        for b in chunks(batches, limit=SCAN_BYTES):
            first, far, rows = [], [], []
            sets = shingle_sets(b.column(2), words)
            ranks, spreads = (np.split(x, np.cumsum([len(s) for s in sets])[:-1]) for x in shared.value.ranks(np.concatenate(sets)))
            for s, rank, spread, key, owner in zip(sets, ranks, spreads, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # a repeated doc_id may bring other texts along
                found = set_key(s) if len(s) else None
                if found is not None and found not in seen and (key is None or found == key):
                    if len(seen) >= SEEN_KEYS:
                        seen.clear()
                    seen.add(found)
                    prefix = np.argsort(rank, kind="stable")[: prefix_length(len(s), percent)]
                    first.append(s[prefix])
                    far.append(spread[prefix])
                    if owner is None:
                        at = int(np.searchsorted(known, found))
                        owner = int(own[at]) if at < len(known) and known[at] == found else found
                    rows.append((found, owner, len(s)))
            if not rows:
                continue
            lens = np.array([len(x) for x in first])
            flat = np.concatenate(first)
            key, owner, size = (np.repeat(np.array(c, np.int64), lens) for c in zip(*rows, strict=True))
            bucket = (mix(np.where(np.concatenate(far), flat ^ mix(key.view(np.uint64)), flat)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            flat, key, owner, size, bucket = flat[by], key[by], owner[by] ^ key[by], size[by], bucket[by]
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            spans = [slice(x, y) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            packed = [pa.array([v[p].tobytes() for p in spans], pa.binary()) for v in (flat, key, owner, size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int64()), *packed], names=["bucket", "tokens", "keys", "owners", "sizes"])

    return texts.select("key", "owner", "text").mapInArrow(run, "bucket long, tokens binary, keys binary, owners binary, sizes binary")


def open_groups(matrix: DataFrame, shared: Broadcast) -> DataFrame:
    """(token, key, owner, n) of the tokens that stand in two groups or more, and of all frequent ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token, key, owner = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("tokens", "keys", "owners"))
        size = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]]).astype(np.int64)
        owner = owner ^ key
        order = np.lexsort((key, token))
        order = order[np.append(True, (token[order][1:] != token[order][:-1]) | (key[order][1:] != key[order][:-1]))]
        token, key, owner, size = token[order], key[order], owner[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        several |= shared.value.ranks(token[first].view(np.uint64))[1]
        keep = np.repeat(several, np.diff(np.append(first, len(token))))
        return pd.DataFrame({"token": token[keep], "key": key[keep], "owner": owner[keep], "n": size[keep]})

    return materialise(matrix.groupBy("bucket").applyInPandas(run, "token long, key long, owner long, n long"))


def least_shared(m: Column, n: Column, percent: int) -> Column:
    """How many prefix tokens sets of m and n tokens share at least if they link."""
    overlap = F.floor((percent * (m + n) + 99 + percent) / (100 + percent))
    return F.least(prefix_length(m, percent) - m, prefix_length(n, percent) - n) + overlap


def matrix_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """(a, b, low, high, shared): pairs of classes of different groups, from qualifying groups, that meet the size and the count bound."""
    counted = materialise(opened.groupBy("key").agg(F.count("*").alias("k")))
    queries = materialise(opened.join(counted, "key").select("token", F.col("key").alias("a"), F.col("owner").alias("g"), F.col("n").alias("m"), "k"))
    union = opened.groupBy("token", F.col("owner").alias("h")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    union = materialise(union)
    # a set looks for sets at least as large as itself
    fits = (F.col("g") != F.col("h")) & (F.col("most") >= F.col("m")) & (percent * F.col("least") <= 100 * F.col("m"))
    met = queries.join(union, "token").where(fits).groupBy("a", "h").agg(
        F.count("*").alias("shared"), F.first("m").alias("m"), F.first("g").alias("g"), F.first("k").alias("k"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    # the count that sizes m and n ask for falls with n, but for rounding, which moves it by less than two
    alone = F.col("lo") == F.col("hi")
    largest = F.least("most", F.floor(100 * F.col("m") / percent))
    bound = F.when(alone, least_shared(F.col("m"), F.col("most"), percent)).otherwise(F.greatest(F.lit(1), least_shared(F.col("m"), largest, percent) - 2))
    qualifying = materialise(met.where((F.col("shared") >= bound) & (F.col("k") >= bound)))
    one = qualifying.where(alone).select("a", F.col("lo").alias("b"), "g", "h", "m", F.col("most").alias("n"), "shared")
    # the groups opened: members that hold tokens of the query set
    several = qualifying.where(~alone).select("a", "h")
    members = opened.select("token", F.col("key").alias("b"), F.col("owner").alias("h"), "n")
    counts = several.join(queries, "a").join(members, ["h", "token"]).groupBy("a", "b").agg(F.first("g").alias("g"), F.first("h").alias("h"), F.first("m").alias("m"), F.first("n").alias("n"), F.count("*").alias("shared"))
    pairs = one.unionByName(counts)
    near = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    asked = near & (100 * F.col("m") >= percent * F.col("n")) & (F.col("shared") >= least_shared(F.col("m"), F.col("n"), percent))
    return materialise(pairs.where(asked).select("a", "b", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "shared"))


def split_hot(opened: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix rows of ordinary tokens, (key, owner, n, lead) of the classes that hold frequent ones, and the rows of these.

    Two classes that share a frequent token are in one cluster, so pairs of ordinary tokens need only count those.
    """
    frequent = materialise(opened.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > HOT_CLASSES))
    hot = materialise(opened.join(frequent, "token"))
    cold = opened.join(frequent.select("token"), "token", "left_anti")
    return cold, materialise(hot.groupBy("key").agg(F.min("token").alias("lead"), F.first("owner").alias("owner"), F.first("n").alias("n"))), hot


def clustered(members: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, owner, n, cluster) of the classes that frequent tokens connect."""
    roots = components(hot.select("key", "token").join(members.select("key", "lead"), "key").select(F.col("lead").alias("a"), F.col("token").alias("b")).distinct())
    return materialise(members.join(roots.withColumnsRenamed({"v": "lead"}), "lead", "left").select("key", "owner", "n", F.coalesce("root", "lead").alias("cluster")))


def _overlaps(rows: np.ndarray, tokens: np.ndarray, n_rows: int, union_tokens: np.ndarray, union_groups: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_rows, n_groups): how many tokens of each row are in each group's union."""
    first, last = np.searchsorted(union_tokens, tokens, side="left"), np.searchsorted(union_tokens, tokens, side="right")
    n = last - first
    out = np.zeros(n_rows * n_groups, np.int64)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
        f, m = first[at:stop], n[at:stop]
        cell = np.repeat(f - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        out += np.bincount(np.repeat(rows[at:stop], m) * n_groups + union_groups[cell], minlength=len(out))
        at = stop
    return out.reshape(n_rows, n_groups)


class Unions:
    """The matrix of a block (keys, owners, sizes, tokens): each group's token union, members and least and greatest size."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
        self.block = keys, owners, sizes, tokens
        self.groups, of = np.unique(owners, return_inverse=True)
        self.sets = np.split(tokens, np.cumsum(sizes)[:-1])
        self.by_group = np.argsort(of, kind="stable")
        self.edge = np.searchsorted(of[self.by_group], np.arange(len(self.groups) + 1))
        self.least, self.most = (f.reduceat(sizes[self.by_group], self.edge[:-1]) for f in (np.minimum, np.maximum))
        group = np.repeat(of, sizes)
        order = np.lexsort((group, tokens))
        tokens, group = tokens[order], group[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])])
        self.tokens, self.of = tokens[fresh], group[fresh]


def block_links(a: tuple, b: tuple | Unions, percent: int) -> list[tuple[int, int, int, int]]:
    """Links from sets of block a to sets of other groups in block b, enough to join all groups that link. A block: keys, owners, sizes, tokens."""
    matrix = b if isinstance(b, Unions) else Unions(*b)
    (ka, oa, na, ta), (kb, _, nb, _) = a, matrix.block
    groups, sets_b, by_group, edge, least, most = matrix.groups, matrix.sets, matrix.by_group, matrix.edge, matrix.least, matrix.most
    if len(groups) == 1 and (oa == groups[0]).all():
        return []
    union_tokens, union_groups = matrix.tokens, matrix.of
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    ends = np.cumsum(na)
    step = max(1, CELLS // len(groups))
    for k in range(0, len(na), step):
        m, lo = na[k : k + step], int(ends[k] - na[k])
        rows, tokens = np.repeat(np.arange(len(m)), m), ta[lo : int(ends[min(k + step, len(na)) - 1])]
        overlap = _overlaps(rows, tokens, len(m), union_tokens, union_groups, len(groups))
        qualifying = (100 * overlap >= percent * m[:, None]) & (100 * most[None, :] >= percent * m[:, None]) & (percent * least[None, :] <= 100 * m[:, None])
        qualifying &= groups[None, :] != oa[k : k + step, None]
        for i in np.flatnonzero(qualifying.any(1)).tolist():
            own, start = int(oa[k + i]), lo + int(m[:i].sum())
            query = ta[start : start + int(m[i])]
            hits = np.flatnonzero(qualifying[i])
            for g in hits[np.argsort(-overlap[i, hits], kind="stable")].tolist():
                if find(own) == find(int(groups[g])):
                    continue
                for j in by_group[edge[g] : edge[g + 1]].tolist():
                    size = int(nb[j])
                    if 100 * min(size, len(query)) < percent * max(size, len(query)):
                        continue
                    shared = common(query, sets_b[j])
                    united = len(query) + size - shared
                    if 100 * shared >= percent * united:
                        parent[find(int(groups[g]))] = find(own)
                        out.append((int(ka[k + i]), int(kb[j]), shared, united))
                        break
    return out


def cluster_links(members: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b, shared, united) that join groups of one cluster, block against block, from the whole texts."""
    # sets that link differ in size by at most a factor, so they are of one band or of neighbouring ones
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) * (0.99999 / math.log(100 / percent))) if percent < 100 else F.col("n"))
    blocks_of = lambda *by: banded.groupBy(*by).agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).alias("parts"))
    parts, splits = materialise(blocks_of("cluster", "band")), materialise(blocks_of("cluster", "band", "owner").withColumnRenamed("parts", "splits"))
    # a group goes to one block, a group larger than a block to several
    where = F.pmod(F.xxhash64("owner", F.pmod(F.xxhash64("key"), F.col("splits"))), F.col("parts")).cast("long")
    dealt = banded.join(parts, ["cluster", "band"]).join(splits, ["cluster", "band", "owner"]).withColumn("part", where)
    wanted = materialise(dealt.join(classes.select("key", "rep"), "key").select("key", F.col("rep").alias("doc_id"), "owner", "cluster", "band", "part"))
    rows = wanted.count()
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        texts = materialise(keyed_texts(docs, wanted.select("doc_id", "key"), rows))
    sets = texts.join(_small(wanted.drop("doc_id"), rows), "key").select("key", "owner", "cluster", "band", "part", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=SCAN_BYTES):
            sets = shingle_sets(b.column(5), words)
            good = [k for k, s in enumerate(sets) if set_key(s) == b.column(0)[k].as_py()]
            rows = b.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array([sets[k].tobytes() for k in good], pa.binary())], names=["key", "owner", "cluster", "band", "part", "tokens"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        one = {**{c: pdf[c].iloc[:1] for c in ("cluster", "band", "part")}, "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "owners": [pdf["owner"].to_numpy(np.int64).tobytes()], "sizes": [np.array([len(t) // 8 for t in pdf["tokens"]], np.int64).tobytes()], "tokens": [b"".join(pdf["tokens"])]}
        return pd.DataFrame(one)

    schema = "key long, owner long, cluster long, band long, part long, tokens binary"
    blocks = materialise(sets.mapInArrow(shingled, schema).groupBy("cluster", "band", "part").applyInPandas(pack, "cluster long, band long, part long, keys binary, owners binary, sizes binary, tokens binary"))
    met = meetings(blocks, parts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            for k in range(b.num_rows):
                at = tuple(col[c][k].as_py() for c in CELL)
                if at != cell:
                    cell, held = at, []
                block = tuple(np.frombuffer(col[c][k].as_py(), kind) for c, kind in (("keys", np.int64), ("owners", np.int64), ("sizes", np.int64), ("tokens", np.uint64)))
                if col["side"][k].as_py() == 0:
                    held.append(Unions(*block))
                    if at[1:3] != at[3:]:
                        continue
                rows = [x for other in held for x in block_links(block, other, percent)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "united"])

    with arrow_rows(blocks.sparkSession, 8):
        return materialise(met.mapInArrow(compare, "a long, b long, shared long, united long"))


#: A square of meetings: blocks of a size band meet those of the same or the next band.
CELL = ["cluster", "band", "square", "band_b", "square_b"]


def meetings(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """The blocks as rows of the squares they belong to (CELL, side), those of side 0 first; in a square of a run of
    blocks with itself they come once."""
    own = parts.select("cluster", "band", F.ceil(F.col("parts") / CELL_BLOCKS).cast("long").alias("squares"))
    after, before = (own.select("cluster", (F.col("band") + step).alias("band"), F.col("squares").alias(name)) for step, name in ((-1, "after"), (1, "before")))
    sides = materialise(own.join(after, ["cluster", "band"], "left").join(before, ["cluster", "band"], "left"))
    band, square = F.col("band"), F.floor(F.col("part") / CELL_BLOCKS).cast("long")

    def row(side: int, *cell: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), *(c.cast("long").alias(n) for c, n in zip(cell, CELL[1:], strict=True)))

    def upto(n: Column, make) -> Column:
        """make(0), ..., make(n - 1); n may be null."""
        return F.transform(F.filter(F.sequence(F.lit(-1).cast("long"), F.coalesce(n, F.lit(0)).cast("long") - 1), lambda k: k >= 0), make)

    cells = F.concat(
        upto(F.col("squares") - square, lambda k: row(0, band, square, band, square + k)),
        upto(F.col("after"), lambda k: row(0, band, square, band + 1, k)),
        upto(square, lambda k: row(1, band, k, band, square)),
        upto(F.col("before"), lambda k: row(1, band - 1, k, band, square)),
    )
    dealt = blocks.join(_small(sides, sides.count()), ["cluster", "band"]).select("cluster", F.explode(cells).alias("cell"), "keys", "owners", "sizes", "tokens")
    dealt = dealt.select("cluster", "cell.*", "keys", "owners", "sizes", "tokens")
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL, "side")


def open_pairs(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join every two groups with a linking pair: the likeliest pair first, then all pairs of the rest."""
    best = pairs.groupBy("low", "high").agg(F.max(F.struct("shared", "a", "b")).alias("top")).select("low", "high", "top.a", "top.b")
    best = materialise(best)
    links = verify(best.select("a", "b"), docs, classes, words, percent)
    joined = materialise(best.join(links.select("a", "b"), ["a", "b"]).select("low", "high"))
    rest = materialise(pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").join(joined, ["low", "high"], "left_anti").select("a", "b"))
    return links if rest.isEmpty() else links.unionByName(verify(rest, docs, classes, words, percent))


def matrix_links(docs: DataFrame, classes: DataFrame, roots: DataFrame, order: Order, n_tokens: int, words: int, percent: int) -> DataFrame:
    """Links (a, b, shared, united) that join all groups that link, in rounds: the last one's frequent tokens are left to the clusters."""
    spark = docs.sparkSession
    context = spark.sparkContext
    grouped = roots.count()
    if grouped <= LOOKUP_ROWS:
        owners = context.broadcast(_arrays(roots, "v", "root"))
        # all rows, as a task meets them: no lookup of the classes' representatives
        texts = docs.where("doc_id is not null").select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("owner"), "text")
    else:
        owners = context.broadcast([np.zeros(0, np.int64)] * 2)
        groups = classes.join(roots.withColumnRenamed("v", "key"), "key", "left").select(F.col("rep").alias("doc_id"), "key", F.coalesce("root", "key").alias("owner"))
        texts = docs.join(groups, "doc_id").select("key", "owner", "text")
    more, before = None, None
    for k in range(ROUNDS + 1):
        shared = context.broadcast(order)  # of a bounded size
        with arrow_rows(spark, ARROW_ROWS):
            opened = open_groups(prefixes(texts, owners, shared, max(64, -(-n_tokens // BUCKET_TOKENS)), words, percent), shared)
        cold, members, hot = split_hot(opened)
        links = open_pairs(matrix_pairs(cold, percent), docs, classes, words, percent)
        more = links if more is None else more.unionByName(links)
        rows, tokens, n_tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(prefix_length(F.col("n"), percent)), F.lit(0)).cast("long")).first()
        if not rows:
            return more
        if k == ROUNDS or tokens <= ROUND_TOKENS or (before is not None and 2 * tokens > before):
            return more.unionByName(cluster_links(clustered(members, hot), docs, classes, words, percent))
        before = tokens
        found = _arrays(hot.select("token", "m").distinct().orderBy(F.desc("m"), "token").limit(FOUND_TOKENS), "token", "m")
        order = order.behind(found[0].view(np.uint64), found[1])
        wanted = materialise(members.select("key", "owner").join(classes.select("key", F.col("rep").alias("doc_id")), "key"))
        with arrow_rows(spark, ARROW_ROWS):
            texts = materialise(keyed_texts(docs, wanted.select("doc_id", "key"), rows)).join(_small(wanted.select("key", "owner"), rows), "key")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to, its own included)."""
    return kept(lambda: _similar_groups(docs, words, percent), docs.sparkSession)


def _similar_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        scanned = materialise(scan(docs, words))
    info = scanned.where("chunk is null").select("doc_id", "n", "key", "bands")
    classes = materialise(info.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")).where("rep is not null"))
    links = verify(star_pairs(classes), docs, classes, words, percent)
    roots = components(links)
    size = classes.agg(F.count("*"), F.sum(prefix_length(F.col("n"), percent))).first()
    if size[0]:
        sketch = sum_sketch(scanned.where("chunk >= 0").select("chunk", "counts"))
        order = Order(sketch, *sampled_counts(scanned.where("chunk < 0").select("chunk", "counts")))
        more = matrix_links(docs, classes, roots, order, int(size[1]), words, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    home = materialise(info.join(roots.withColumnRenamed("v", "key"), "key", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("home")))
    least = materialise(home.where("home is not null").groupBy("home").agg(F.min("doc_id").alias("least")))
    return home.join(least, "home", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with the least doc_id of every group of similar texts only; rows without an id stay.

    Of rows that repeat a doc_id those with the same text count once; the others stay if one of them stands for its
    group, so that no group loses its document.
    """
    found = similar_groups(docs, words, percent)
    ids = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("rows")))
    gone, repeated = ids.where("gone").select("doc_id"), ids.where("not gone and rows > 1").select("doc_id")
    kept = without(docs, gone, gone.count())
    n = repeated.count()
    if not n:
        return kept
    again = _small(repeated, n)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
