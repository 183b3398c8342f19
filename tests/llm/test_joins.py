"""N-gram Jaccard join, components, top-k search, media and chats."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepframe.llm import chat, media, ngram_join, shingles, topk, webp_lossless
from stepframe.llm.components import components
from stepframe.llm.jvm import webp
from stepframe.shared import materialise


def brute_set(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets, parent = [brute_set(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in held.get(t, ())).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for t in s:
            held.setdefault(t, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def test_shingle_sets_at_every_block_size(monkeypatch):
    texts = ["a b c d e f", "A b\tc d e F ", None, "", "  ", "x y", "x  y\n", "é b c d e f g " * 10, "word" * 50 + " a b c d e", "a", "a\x00b c\x1cd e f"]
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(shingles, "BLOCK", block)
        sets = shingles.shingle_sets(pa.array(texts))
        assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    assert shingles.set_key(sets[0]) == shingles.set_key(sets[1]) and shingles.set_key(sets[5]) == shingles.set_key(sets[6])


def near_corpus(seed, n=150, bases=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400))
    bases = [[word() for _ in range(rng.randint(3, 120))] for _ in range(bases)]
    passage = [word() for _ in range(50)]
    docs = []
    for k in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = passage + w
        docs.append((k + 10, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_against_brute_force(spark, seed):
    # with two origins only, their tokens are frequent and go through blocks
    docs = near_corpus(seed, bases=2 if seed == 3 else 12)
    if seed == 2:
        docs += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "q " * 40_000), (905, "q " * 30_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == brute_components(docs)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in got}


def block(first, sets, owners):
    return first + np.arange(len(sets)), np.array(owners), np.array([len(s) for s in sets]), np.concatenate(sets)


def test_blocks_of_a_cluster_meet_once_and_are_copied_by_squares(spark):
    counts = {3: 70, 4: 20, 6: 1}  # size band: blocks
    blocks = [(1, band, part, *[b"%d,%d" % (band, part)] * 4) for band, n in counts.items() for part in range(n)]
    blocks = spark.createDataFrame(blocks, "cluster long, band long, part long, keys binary, owners binary, sizes binary, tokens binary")
    parts = spark.createDataFrame([(1, band, n) for band, n in counts.items()], "cluster long, band long, parts long")
    squares, copies = defaultdict(lambda: ([], [])), Counter()
    for r in ngram_join.meetings(blocks, parts).collect():
        band, part = map(int, bytes(r["keys"]).split(b","))
        squares[tuple(r[c] for c in ngram_join.CELL)][r["side"]].append((band, part))
        copies[band, part] += 1
    met = Counter()
    for at, (held, streamed) in squares.items():
        assert max(len(held), len(streamed)) <= ngram_join.CELL_BLOCKS
        met.update(tuple(sorted((x, y))) for x in held for y in (held if at[1:3] == at[3:] else streamed) if at[1:3] != at[3:] or x <= y)
    every = [(band, part) for band, n in counts.items() for part in range(n)]
    assert met == Counter((x, y) for x in every for y in every if x <= y and y[0] - x[0] <= 1)
    # pair by pair a block of band 3 would be copied 91 times
    assert max(copies.values()) <= -(-70 // ngram_join.CELL_BLOCKS) + -(-20 // ngram_join.CELL_BLOCKS)


def test_frequent_tokens_come_last_where_the_sketch_is_full(spark):
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(6))} one line that all of these texts hold" for i in range(400)]
    scanned = ngram_join.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    tokens, counts = ngram_join.sampled_counts(scanned.where("chunk < 0").select("chunk", "counts"))
    sets = shingles.shingle_sets(pa.array(texts))
    chosen = [s for s in sets if shingles.set_key(s) % ngram_join.SAMPLED == 0]
    found, n = np.unique(np.concatenate(chosen), return_counts=True)
    assert tokens.tolist() == found[n > 1].tolist() and counts.tolist() == n[n > 1].tolist() and len(tokens)
    # every cell counts alike, as in a very large table
    order = ngram_join.Order(np.full(1 << ngram_join.SKETCH_BITS, 1_000_000, np.int32), tokens, counts)
    for s in sets:
        rank, spread = order.ranks(s)
        first = s[np.argsort(rank, kind="stable")[: ngram_join.prefix_length(len(s))]]
        assert not np.isin(first, tokens).any() and not spread.any()


def test_block_links_join_what_brute_force_joins():
    rng = np.random.default_rng(11)
    origin = [np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(6)]
    sides = []
    for side in range(2):
        sets, owners = [], []
        for k in range(60):
            s = origin[k % 6].copy()
            s[rng.choice(len(s), rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)[0] + np.arange(1, dtype=np.uint64)
            sets.append(np.unique(s))
            owners.append(int(rng.integers(0, 25)) + 100 * side)
        sides.append((sets, owners))
    got = ngram_join.block_links(block(0, *sides[0]), block(1000, *sides[1]), 80)
    key_of = {1000 * side + k: o for side, (_, owners) in enumerate(sides) for k, o in enumerate(owners)}

    def joined(links):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for g, h in links:
            parent[max(find(g), find(h))] = min(find(g), find(h))
        return {x: find(x) for x in list(parent)}

    want = []
    for s, g in zip(*sides[0]):
        for r, h in zip(*sides[1]):
            shared = len(np.intersect1d(s, r))
            if g != h and 100 * shared >= 80 * (len(s) + len(r) - shared):
                want.append((g, h))
    assert want and joined(want) == joined([(key_of[a], key_of[b]) for a, b, _, _ in got])
    for a, b, shared, united in got:
        assert 100 * shared >= 80 * united


def test_blocks_of_tiny_sets_stay_small():
    import tracemalloc

    rng = np.random.default_rng(12)
    sets = [np.sort(rng.integers(0, 1 << 60, 2).astype(np.uint64)) for _ in range(4000)]
    one = block(0, sets, list(range(4000)))
    tracemalloc.start()
    assert ngram_join.block_links(one, one, 80) == []
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_group_bound_loses_no_pair(spark):
    rng = random.Random(13)
    rows, sets = [], []
    for g in range(12):
        base = rng.sample(range(400), rng.randint(5, 60))
        for _ in range(rng.choice([1, 1, 3, 6])):
            s = sorted({x if rng.random() < 0.9 else rng.randrange(400) for x in base})
            sets.append((len(sets), rng.randrange(30), s))
    for key, owner, s in sets:
        rows += [(t, key, owner, len(s)) for t in s[: ngram_join.prefix_length(len(s))]]
    got = ngram_join.matrix_pairs(spark.createDataFrame(rows, "token long, key long, owner long, n long"), 80).collect()
    want = {(min(a, b), max(a, b)) for a, g, s in sets for b, h, r in sets if a < b and g != h and 100 * len(set(s) & set(r)) >= 80 * len(set(s) | set(r))}
    assert len(want) > 5 and want <= {(min(r.a, r.b), max(r.a, r.b)) for r in got}


def test_large_lookups_do_not_shuffle_the_texts(spark, monkeypatch):
    docs = near_corpus(11) + [(10_000, None), (10_001, ""), (10_002, "one two three")]
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string")
    want = brute_components(docs)
    small = ngram_join._small

    def looked_up(table, rows):
        assert rows <= ngram_join.BROADCAST_ROWS or "doc_id" not in table.columns, "all texts go through a shuffle"
        return small(table, rows)

    monkeypatch.setattr(ngram_join, "_small", looked_up)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(df).collect() if r.doc_id is not None)
    assert got == want
    kept = {r.doc_id for r in ngram_join.one_of_each(df).collect()}
    assert kept == {d for d, _, c in want if d == c} | {None}


@pytest.mark.parametrize("rounds", [0, 4])
def test_frequent_tokens_go_through_the_matrix_again(spark, monkeypatch, rounds):
    # one passage in many texts, which is frequent though the sketch puts all tokens alike
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 5000))
    passage = [word() for _ in range(8)]
    docs = [(k, " ".join(word() for _ in range(10)) + " " + " ".join(passage) + " " + " ".join(word() for _ in range(4))) for k in range(120)]
    docs += [(1000 + k, docs[k][1] + " more") for k in range(0, 40, 3)]
    held = []
    links, zeros = ngram_join.cluster_links, np.zeros
    monkeypatch.setattr(ngram_join, "cluster_links", lambda members, *a: held.append(members.count()) or links(members, *a))
    monkeypatch.setattr(ngram_join, "sum_sketch", lambda partial: zeros(1 << ngram_join.SKETCH_BITS, np.int32))
    monkeypatch.setattr(ngram_join, "sampled_counts", lambda partial: (zeros(0, np.uint64), zeros(0, np.int32)))
    monkeypatch.setattr(ngram_join, "ROUND_TOKENS", 0)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_components(docs)
    assert (sum(held) > 20) == (rounds == 0)


def test_repeated_ids_keep_one_of_each_group(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "x y z")
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (3, b), (3, c), (4, a), (None, a)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each(df).collect())
    assert kept == [(0, a), (1, a), (2, b), (3, b), (3, c)]


def test_jaccard_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.similar_groups(blank).collect() if r.doc_id) == [(1, 1), (2, 2)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(200, 200 + k) for k in range(1, 40)]
    parent = {v: v for e in links for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 40)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(k, x[k].tolist(), 1) for k in range(700)] + [(700, None, 1), (750, [], 1), (None, [1.0], 1), (751, [float("nan")] * 40, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    bits = np.zeros((752, 40), bool)
    bits[:700] = x > 0
    ids = np.array([*range(700), 750, 751])
    want = []
    for q in ids[ids % 50 == 0]:
        d = (bits[ids] != bits[q]).sum(1)
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        want += [(int(q), k + 1, int(ids[i]), int(d[i])) for k, i in enumerate(order)]
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeated_ids_over_many_shards(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 20))
    x[1], x[50:60], x[100:160] = -x[0], x[0], -x[0]
    ids = np.arange(300)
    ids[1] = 0
    df = spark.createDataFrame([(int(i), v.tolist(), 0, 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, query_id int, id int")
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        d = ((x > 0) != (x[q] > 0)).sum(1)
        order = [i for i in np.lexsort((ids, d)) if i != q][:3]
        want += [(int(ids[q]), k + 1, int(ids[i]), int(d[i])) for k, i in enumerate(order)]
    for shard_rows in (1000, 40):
        got = topk.top_k(df, k=3, shard_rows=shard_rows).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_multi_index_stops_early_but_misses_nothing():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    index = topk.MultiIndex(codes, np.arange(3000))
    for q in range(0, 60, 7):
        d = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:5]
        assert index.search(codes[q], q, 5, []) == [(int(d[i]), int(i)) for i in order]


def image(rng, h, w, kind):
    if kind == 0:
        return rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    if kind == 1:
        return rng.choice(rng.integers(0, 2**32, 5, dtype=np.uint32), (h, w))
    if kind == 2:
        return ((np.add.outer(np.arange(h) * 3, np.arange(w) * 2) & 255) * 0x010101 + 0xFF000000).astype(np.uint32)
    return np.resize(rng.integers(0, 2**32, 7, dtype=np.uint32), (h, w))


def test_webp_transforms_round_trip():
    rng = np.random.default_rng(7)
    files, pixels = [], []
    for t in range(80):
        h, w = (int(x) for x in rng.integers(1, 20, 2))
        a, options = image(rng, h, w, t % 4), {}
        blocks = -(-w // 4) * -(-h // 4)
        if t % 3 == 0:
            options["predictor"] = (2, [int(x) for x in rng.integers(0, 16, blocks)])
        if t % 5 == 0:
            options["cross"] = (2, [int(x) for x in rng.integers(0, 2**24, blocks)])
        options["subtract_green"] = t % 2 == 0
        if t % 4 in (1, 3) and t % 7 < 3:
            options = {"palette": True}
        if t % 7 == 0:
            options["cache_bits"] = int(rng.integers(1, 12))
        if t % 11 == 0 and "palette" not in options:
            options["grid"] = (2, [int(x) for x in rng.integers(0, 3, blocks)])
        files.append(webp_lossless.encode(a, **options))
        pixels.append(a)
        assert (webp_lossless.decode(files[-1]) == a).all(), (t, options)
    for a, b in zip(webp_lossless.decode_many(files), pixels, strict=True):
        assert (a == b).all()


def test_jvm_codec_against_the_plain_one(spark):
    rng = np.random.default_rng(17)
    files, pixels = [], []
    for t in range(60):
        h, w = (int(x) for x in rng.integers(1, 20, 2))
        a, options, blocks = image(rng, h, w, t % 4), {}, -(-w // 4) * -(-h // 4)
        if t % 3 == 0:
            options["predictor"] = (2, [int(x) for x in rng.integers(0, 16, blocks)])
        if t % 5 == 0:
            options["cross"] = (2, [int(x) for x in rng.integers(0, 2**24, blocks)])
        options["subtract_green"] = t % 2 == 0
        if t % 4 in (1, 3) and t % 7 < 3:
            options = {"palette": True}
        if t % 7 == 0:
            options["cache_bits"] = int(rng.integers(1, 12))
        if t % 11 == 0 and "palette" not in options:
            options["grid"] = (2, [int(x) for x in rng.integers(0, 3, blocks)])
        files.append(webp_lossless.encode(a, **options))
        pixels.append(a)
    # the JVM decoder reads what the plain encoder wrote
    (row,) = spark.createDataFrame([(bytearray(b"".join(files)),)], "m binary").select(webp(spark, decode=True)("m").alias("x")).collect()
    for a, b in zip(media.pixel_arrays(bytes(row.x)), pixels, strict=True):
        assert (a == b).all()
    # and the plain decoder what the JVM encoder wrote
    text = (b"The quick brown fox jumps over the lazy dog. " * 4000)[: 64 * 2500]
    payloads = [bytes(64), bytes(range(256)), rng.integers(0, 256, 64 * 40, dtype=np.uint8).tobytes(), text, b"ab" * 32 * 30, np.cumsum(rng.integers(0, 3, (300, 64)), axis=0).astype(np.uint8).tobytes()]
    red = rng.integers(0, 256, (200, 16))
    tinted = np.stack([red * 2 % 256, red, red, np.full_like(red, 255)], axis=-1).astype(np.uint8)
    payloads += [tinted.tobytes(), np.repeat(rng.integers(0, 256, 64 * 60, dtype=np.uint8), 4).tobytes()]
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(payloads)], "k int, p binary")
    media_ = [bytes(r.m) for r in df.select("k", webp(spark, decode=False)("p").alias("m")).orderBy("k").collect()]
    for p, m, images in zip(payloads, media_, media.decode_media(media_), strict=True):
        assert media.samples(images).tobytes() == p and len(m) < len(p) + 1000
    kinds = {t[0] for m in media_ for f in media.split_files(m) for t in webp_lossless.read_head(f)[4]}
    assert {webp_lossless.PREDICTOR, webp_lossless.PALETTE} <= kinds and kinds & {webp_lossless.CROSS_COLOUR, webp_lossless.SUBTRACT_GREEN}
    for bad in (files[0][:30], b"JUNK" + files[0][4:], files[1][:20] + b"\x00" + files[1][21:], files[2][:-8], b""):
        with pytest.raises(Exception, match="WebP"):
            spark.createDataFrame([(bytearray(bad),)], "m binary").select(webp(spark, decode=True)("m")).collect()


def test_media_of_documents_use_the_decoder(spark):
    """What the media of a real table hold: back-references, colour caches, prefix codes and transforms."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = Counter()
    for r in media.store_media(docs).select("media").collect():
        for f in media.split_files(bytes(r.media)):
            b, w, h, coded, transforms = webp_lossless.read_head(f)
            found.update(t[0] for t in transforms)
            found["files"] += 1
            found["cache"] += b.read(1)
    assert found["files"] >= 200 and found["cache"] > found["files"] // 3
    assert found[webp_lossless.PALETTE] + found[webp_lossless.PREDICTOR] > 0


def test_media_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b"), (7, "c"), ((1 << 53) + 1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in media.media_digests(df).collect())
    sha = lambda t: hashlib.sha256(t + bytes(64 - len(t))).hexdigest()
    assert got == sorted([(0, 1, sha(b"a")), (0, 1, sha(b"a")), (7, 1, sha(b"b")), (7, 1, sha(b"c")), ((1 << 53) + 1, 0, sha(b""))])


def test_broken_images():
    f = webp_lossless.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", f[:30], b"JUNK" + f[4:], f[:20] + b"\x00" + f[21:], f[:-8]):
        with pytest.raises(ValueError):
            webp_lossless.decode(bad)
        with pytest.raises(ValueError):
            webp_lossless.decode_many([bad])
    with pytest.raises(ValueError):
        media.split_files(b"xx")


def test_media_digests(spark):
    texts = [None, "", "a", "é" * 31 + "x", "z" * 20_000, "The quick brown fox. " * 3000, "same", "same", "0" * 64]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, media int").repartition(2)
    got = {r.doc_id: r for r in media.media_digests(df).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[6][2:] == got[7][2:] and got[5].media_bytes < got[5].n_bytes / 1.5
    stored = media.read_media(media.store_media(df)).collect()
    assert all(hashlib.sha256(r.media).hexdigest() == got[r.doc_id].media_sha256 for r in stored)
    assert media.media_digests(df.limit(0)).count() == 0


def call(i, needs=(), name="f", arguments=None):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": {"x": 1} if arguments is None else arguments, "depends_on": list(needs)}) + "</tool_call>"


def test_chats(spark):
    rows = [
        (1, 0, "user", 'hi "q" \n é\\'),
        (1, 1, "assistant", "t " + call("a", ["b"]) + call("b", arguments={"x": "no"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "r"})),
        (1, 3, "assistant", call("c", ["a", "lost"], arguments={"b": 2.5, "x": 5}) + "<tool_call>broken</tool_call>"),
        (1, 4, "assistant", call("a", name="other")),
        (2, 0, "assistant", call("p", ["q"]) + call("q", ["p"]) + call("z")),
        (3, 0, None, None),
        (3, 0, "user", ""),
        (None, 1, "user", "x"),
        (4, 5000, "user", "far"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, level int")
    schemas = {"f": {"x": (("integer",), True), "b": (("number",), False)}}
    got = {(r.conv_id, r.segment): r for r in chat.format_chats(df, schemas, turns=False).collect()}
    one = json.loads(got[1, 0].chat)
    assert [(c["id"], c["valid"], c["linked"]) for c in one["calls"]] == [("b", False, True), ("a", True, False), ("c", True, False)]
    assert [m["content"] for m in one["messages"]] == [r[3] for r in rows[:5]]
    assert one["calls"][2]["arguments"] == {"b": 2.5, "x": 5} and '"arguments":{"b":2.5,"x":5}' in got[1, 0].chat
    assert [c["id"] for c in json.loads(got[2, 0].chat)["calls"]] == ["z", "p", "q"]
    assert json.loads(got[3, 0].chat)["messages"] == [{"turn": 0}, {"content": "", "role": "user", "turn": 0}]
    assert (4, 4) in got and len(got) == 4
    for r in got.values():
        assert r.chat == json.dumps(json.loads(r.chat), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    turns = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert turns[1].n_calls == 4 and turns[1].n_linked == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_forward_dependencies_in_long_conversations(spark):
    n = 60
    rows = [(1, k, "assistant", call(f"k{k}", [f"k{k + 1}"] if k % 2 == 0 else [f"k{k - 3}"] if k >= 3 else [])) for k in range(n)]
    got = chat.linked_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {}).collect()
    key = {r.call_id: tuple(r.key) for r in got if r.key is not None}
    for k in range(n):
        for need in [f"k{k + 1}"] if k % 2 == 0 else [f"k{k - 3}"] if k >= 3 else []:
            if f"k{k}" in key and need in key:
                assert key[need] < key[f"k{k}"]
    assert len(key) == n


def test_crowded_turns_are_cut(spark):
    rows = [(1, 0, "user", "same")] * 500 + [(1, 1, "assistant", call(f"c{k}")) for k in range(30)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_chats(df, {"f": {"x": (("integer",), True)}}, turns=False, crowded=100).collect()
    one = [r for r in got if r.conv_id == 1]
    assert len(one) == 6 and sum(r.n_messages for r in one) == 530 and sum(r.n_calls for r in one) == sum(r.n_valid for r in one) == 30
    assert max(r.n_messages for r in one) < 150 and sum(len(json.loads(r.chat)["calls"]) for r in one) == 30 and len(got) == 7


def test_cycles_take_few_rounds(spark, monkeypatch):
    rows = [(1, k, "assistant", call(f"k{k}", [f"k{k - 1}"] if k else [])) for k in range(1000)]
    rows += [(1, 1000, "assistant", call("a", ["b"]) + call("b", ["a"]) + call("c", ["b"])), (2, 3, "assistant", call("s", ["s"]) + call("t"))]
    rows += [(3, k, "assistant", call(f"r{k}", [f"r{(k + 1) % 4}"])) for k in range(4)] + [(3, 9, "assistant", call("free"))]
    count = []
    monkeypatch.setattr(chat, "materialise", lambda df, *more: count.append(1) or materialise(df, *more))
    got = chat.linked_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {}).collect()
    assert {(r.conv_id, r.call_id) for r in got if r.key is None} == {(1, "a"), (1, "b"), (2, "s"), *((3, f"r{k}") for k in range(4))}
    assert len(got) == 1003 + 2 + 5 and len(count) < 30


def test_native_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.format_chats(df).where(F.col("n_linked") == 1).count() == 1
