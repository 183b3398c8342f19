"""Token output, packing and the BPE codec."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepframe.llm import bpe, packing, token_output
from stepframe.llm.jvm import token_coder
from stepframe.llm.words import LibraryEncoder, PieceEncoder, default_vocabulary, library_encoder

TEXTS = ["", None, "Hello  World's 123 <|endoftext|>x<|startoftext|> don't\tfoo\x1cbar aaaa aaaaa", "ΑΣ ΣΑΣ İstanbul ﬁ é 日本語 😀👍🏽 ½²٣ \x00y", "the of and " * 3000, "same", "same", "foo., bar! (x) a'b é ́z"]


@pytest.fixture
def docs(spark):
    rows = [(k * 3, t, "clash", k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def want(library):
    return [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_piece_encoders_equal_whole_texts(library):
    ids = want(library)
    model = bpe.load(default_vocabulary())
    assert [x.tolist() for x in model.encode(TEXTS)] == ids
    flat, lens = library_encoder(default_vocabulary()).encode(TEXTS)
    assert flat.tolist() == [x for i in ids for x in i] and lens.tolist() == list(map(len, ids))
    assert [model.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_library_encoder_looks_up_distinct_runs_only(library):
    """Arrow arrays go in as they are; a run of letters is looked up once a call, not once for each place, case or tail."""
    texts = [None, "The the, the.\ntHe  x é, é. É" * 2000, "", "the"]
    encoder, looked = LibraryEncoder(default_vocabulary()), []

    class Counting(type(encoder.letters.codes)):
        def get(self, piece, default=None):
            looked.append(piece)
            return super().get(piece, default)

        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    encoder.letters.codes = Counting()
    for kind in (pa.string(), pa.large_string()):
        looked.clear()
        flat, lens = encoder.encode(pa.array(["cut off", *texts, "cut off"], kind).slice(1, len(texts)))
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sorted(looked) == sorted({"the", "x", "é", "É", "ÉThe"})


def test_letters_that_normalise_to_marks_join_their_tails(library):
    texts = ["İ.", "aİ, x", "\u0958. \ufb2e!", "İstanbul. \u0929."]
    texts += ["".join(r) for r in np.random.default_rng(4).choice(list("aZéÉİΣσǅ̧́ \n\t\x1c.,;!#'stl01_<|>日각ﬁ½Ⅷ\x00\u0958"), (500, 40))]
    flat, lens = LibraryEncoder(default_vocabulary()).encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_digests(docs, library):
    got = {r.doc_id: r for r in bpe.bpe_digests(docs).collect()}
    for k, ids in enumerate(want(library)):
        r = got[k * 3]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in bpe.bpe_encode(docs).collect()}
    assert full[6].ids == want(library)[2]


def test_token_files_in_order(docs, library):
    got = sorted(token_output.token_digests(docs).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, ids in zip(got, want(library), strict=True):
        ids = ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_output_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.token_digests(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert bpe.bpe_digests(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.start for r in token_output.token_digests(twice).collect()) == [0, 1, 4]


def test_token_output_keeps_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b"), (None, None), (0, "c")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.token_digests(docs).collect())
    assert got == [(0, None, 1), (1, None, 3), (4, 0, 2), (6, 1, 3)]


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 12_289])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65_536, n), np.zeros(n, np.int64), rng.zipf(1.3, n) % 49_408, np.full(n, 65_535), np.tile([7, 8, 9], n)[:n]):
        raw = token_output.write_frames([(np.array([5]), np.array([n]), ids), (np.array([6]), np.array([2]), ids[:2] if n > 1 else np.array([1, 1]))])
        back = token_output.read_frames(raw)
        assert (back[0][2] == ids).all() and back[0][0].tolist() == [5] and len(back[1][2]) == 2


def test_range_coder_compresses_and_blocks_are_independent():
    ids = np.tile(np.random.default_rng(0).integers(0, 500, 700), 20)
    (raw,) = token_output.write_frames([(np.array([1]), np.array([len(ids)]), ids)])
    assert len(raw) < len(ids)
    words, counts = token_output.encode_blocks(ids, np.array([4096, 4096, len(ids) - 8192]))
    second = token_output.decode_blocks(words[counts[0] : counts[0] + counts[1]], counts[1:2], np.array([4096]))
    assert (second == ids[4096:8192]).all()


def test_damage_is_found():
    ids = np.arange(5000) % 300
    (raw,) = token_output.write_frames([(np.array([1]), np.array([5000]), ids)])
    for bad in (raw[:-2], b"XXXX" + raw[4:], raw[: len(raw) // 2] + bytes([raw[len(raw) // 2] ^ 0x55]) + raw[len(raw) // 2 + 1 :], raw[:10]):
        with pytest.raises(ValueError):
            token_output.read_frames([bad])
    with pytest.raises(ValueError):
        token_output.write_frames([(np.array([1]), np.array([1]), np.array([70_000]))])


def test_jvm_coder_writes_the_same_frames_as_the_plain_one(spark):
    rng = np.random.default_rng(1)
    groups = []
    for n in (1, 2, 4095, 65_536, 65_537, 70_000):
        for ids in (rng.integers(0, 65_536, n), np.zeros(n, np.int64), rng.zipf(1.3, n) % 49_408, np.full(n, 65_535), np.tile([7, 8, 9], n)[:n])[n % 3 :: 2]:
            groups.append((np.ma.array([5, 0], mask=[False, n % 2 == 0]), np.array([n - 1, 1]), ids))
    plain, coded = [token_output.plain_frame(*g) for g in groups], token_output.write_frames(groups)
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(plain)], "k int, plain binary").repartition(3)
    df = df.select("k", token_coder(spark, decode=False)("plain").alias("coded")).select("k", "coded", token_coder(spark, decode=True)("coded").alias("back"))
    rows = df.orderBy("k").collect()
    assert [bytes(r.coded) for r in rows] == coded and [bytes(r.back) for r in rows] == plain
    assert (token_output.read_frames(coded[:1])[0][2] == groups[0][2]).all()
    damaged = bytearray(coded[-1][:-9] + bytes([coded[-1][-9] ^ 0x55]) + coded[-1][-8:])
    for bad in (damaged, coded[-1][:-2], plain[0], b""):
        with pytest.raises(Exception, match="token frame"):
            spark.createDataFrame([(bytearray(bad),)], "x binary").select(token_coder(spark, decode=True)("x")).collect()


def test_text_longer_than_a_frame_and_vocabulary_over_16_bits(spark):
    docs = spark.createDataFrame([(1, "the of and " * 200), (2, "x"), (3, "a b " * 60)], "doc_id long, text string").coalesce(1)
    got = token_output.token_digests(docs, frame_ids=100).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in got] == [(0, 601), (601, 2), (603, 121)]
    wide = PieceEncoder(lambda pieces: (np.full(len(pieces), 70_000), np.ones(len(pieces), np.int64)))
    ids, _ = wide.encode(["a b"])
    assert ids.tolist() == [70_000] * 2
    with pytest.raises(ValueError):
        token_output.plain_frame(np.array([1]), np.array([2]), ids)


def test_best_fit_decreasing_against_brute_force():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 64, 300)
    window, offset, n = packing.best_fit_decreasing(lengths, 64)
    rooms, expect = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            room = min(r for r, _ in fits)
            rooms[next(w for r, w in fits if r == room)] -= lengths[i]
        else:
            rooms.append(64 - lengths[i])
    assert n == len(rooms) and sorted(64 - np.bincount(window, weights=lengths).astype(int)) == sorted(rooms)
    del expect
    for w in range(n):
        at = np.sort(offset[window == w])
        own = lengths[window == w][np.argsort(offset[window == w])]
        assert at.tolist() == (np.cumsum(own) - own).tolist()


def test_rows_of_one_id_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "a b")] * 300 + [(7, "a b")] * 300, "doc_id long, text string")
    sizes = [r["count"] for r in packing.dealt(packing.materialise(packing.cut_documents(docs)), 10).groupBy("shard").count().collect()]
    assert sum(sizes) == 600 and len(sizes) == 10 and max(sizes) < 120
    packed = packing.pack(docs, shard_pieces=60)
    assert packed.where("doc_id is null").count() == packed.where("doc_id = 7").count() == 300


def test_pack_keeps_large_ids_beside_null_ones(spark):
    ids = [None, (1 << 53) + 1, (1 << 53) + 3, None, -5]
    packed = packing.pack(spark.createDataFrame([(i, "a b", 0) for i in ids], "doc_id long, text string, shard int").coalesce(1)).collect()
    assert sorted((r.doc_id or 0) for r in packed) == sorted(i or 0 for i in ids)
    assert [r.doc_id for r in sorted(packed, key=lambda r: r.offset)] == [None, None, -5, (1 << 53) + 1, (1 << 53) + 3]


def test_pack_over_many_shards_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BLOCK", 3)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), (F.col("id") * 37 % 5000).cast("int")).alias("text"))
    rows = packing.pack(docs, shard_pieces=20).collect()
    assert sorted({r.sequence_id for r in rows}) == list(range(len({r.sequence_id for r in rows})))
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096


def test_pack_covers_every_id_once(docs, library):
    p = packing.pack(docs, shard_pieces=4).cache()
    rows = p.collect()
    for k, ids in enumerate(want(library)):
        own = sorted((r for r in rows if r.doc_id == 3 * k), key=lambda r: r.start)
        ids = ids + [2]
        assert own[0].start == 0 and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.length <= 4096
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    seq = {r.sequence_id: r.ids for r in packing.sequences(docs.select("doc_id", "text"), p).collect()}
    assert sum(map(len, seq.values())) == sum(r.length for r in rows)
    assert p.where(F.col("sequence_id").isNull()).count() == 0
