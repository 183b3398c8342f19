"""The pipeline, stage by stage, on the small tables."""

import random
import zlib

import numpy as np

import corpus_pipeline
from stepframe.llm import queries
from stepframe.llm.words import default_vocabulary


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "personal_data", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf), spark)
        assert out.columns == docs.columns, name
        if name != "personal_data":
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] > counts[3] == counts[4]
    assert docs.where("text rlike '@mail[0-9]\\.example'").count() == 0
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_run_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    syllables = {"aa": ["ka", "ko", "ki", "tan"], "bb": ["sch", "en", "ung", "der"], "cc": ["eau", "oui", "le", "tre"], "dd": ["lla", "cion", "que", "dor"]}
    texts, langs = {}, {}
    for k in range(480):
        langs[k] = sorted(syllables)[k % 4]
        words = ["".join(rng.choice(syllables[langs[k]]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        texts[k] = " ".join(words)
    toxic = {k for k in texts if k % 7 == 0}
    for k in toxic:
        texts[k] = texts[k].replace(" ", " nastyword ", 1) + " nastyword vileterm"
    copies = {500 + k: texts[k] for k in (1, 2, 3, 4)}
    private = {k: " write to some.one@mail1.example.com" for k in (5, 6)}
    foreign = {600: "съешь же ещё этих мягких французских булок да выпей чаю " * 3, 601: "123 456 !!"}
    rows = [(k, t + private.get(k, ""), langs.get(k)) for k, t in (texts | copies | foreign).items()]
    spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    library, want = Tokenizer.from_file(default_vocabulary()), set()
    for k in texts.keys() - toxic:
        text = texts[k] + private.get(k, "").replace("some.one@mail1.example.com", "<EMAIL>")
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.add((k, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns with clashing names, empty tables, at every stage."""
    rng = random.Random(12)
    syllables = {"aa": ["ka", "ko", "ki", "tan"], "bb": ["sch", "en", "ung", "der"]}
    rows = []
    for k in range(120):
        lang = sorted(syllables)[k % 2]
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(10, 40)))
        rows.append((k, text + (" nastyword" * 3 if k % 5 == 0 else ""), lang, "s", len(text), "key", 1))
    good = rows[1][1]
    rows += [(500, None, None, None, None, None, None), (501, "", "aa", "s", 0, "a", 2), (None, good, "aa", None, 3, "b", 3), (1, good, "aa", "s", 9, "c", 4), (502, rows[2][1] + " a.b@c.de", "aa", "s", None, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, shard int")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(120)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    by = dict(corpus_pipeline.STAGES)
    clean = by["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k in range(120) if k % 5} | {500, 501, None, 502}
    known = by["language_id"](spark, clean, sf)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == {k for k in range(120) if k % 5} | {None, 502}
    one = by["near_duplicates"](spark, docs, sf)
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert one.columns == docs.columns and (500, None) in left and (501, "") in left and left.count((1, good)) == 1
    masked = by["personal_data"](spark, docs, sf)
    got = {r.doc_id: r for r in masked.where("doc_id in (500, 501, 502)").collect()}
    assert masked.count() == docs.count() and got[500].text is None and got[501].text == "" and got[502].text.endswith(" <EMAIL>") and got[502].n_chars is None
    packed = by["packing"](spark, docs, sf)
    assert packed.count() == docs.count() and packed.where("doc_id is null").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
