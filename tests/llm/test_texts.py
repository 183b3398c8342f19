"""Language identification, toxicity and personal data."""

import base64
import random
import re
import time
import string

import numpy as np
from pyspark.sql import functions as F

from stepframe.llm import langid, pii, toxicity

SYL = {"aa": ["ka", "ko", "ki", "tan"], "bb": ["sch", "en", "ung", "der"], "cc": ["eau", "oui", "le", "tre"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240, toxic=True):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        lang = sorted(SYL)[k % 3]
        text = words(rng, lang, rng.randint(5, 60))
        bad = k % 4 == 0
        if toxic and bad:
            text = text.replace(" ", " nastyword ", 1) + " nastyword vileterm"
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 !!", "bb", None, 6), (1003, "ka " * 200_000, "aa", "s", None), (None, "der ung", None, "s", 7)]
    labels += [(0, 1, 1), (0, 1, 0), (5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("severity", F.lit("clash")).withColumn("score", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language_identification(spark):
    docs, _ = corpus(spark)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    import zlib

    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in held) for k in range(240))
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.95
    for k in (1000, 1001, 1002):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values()) and None in got
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(240)) | {1003, None}


def test_language_learns_nothing_from_held_out_or_empty(spark):
    docs, _ = corpus(spark)
    held = docs.where(langid.held_out(F.col("doc_id")))
    assert langid.train(held).languages == []
    assert {r.lang_pred for r in langid.identify(held, langid.train(held)).collect()} == {"und"}
    empty = docs.limit(0)
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_texts_in_no_learned_language_go(spark):
    # four languages: the largest of four probabilities is never below 1/4
    rng = random.Random(3)
    syllables = SYL | {"dd": ["lla", "cion", "que", "dor"]}
    clean = []
    for k in range(480):
        lang = sorted(syllables)[k % 4]
        clean.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    mixed = [(600, clean[4][1] + " " + clean[5][1], "aa")]
    foreign = [
        (700, "съешь же ещё этих мягких французских булок да выпей чаю " * 3, None),
        (701, "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏" * 3, None),
        (702, base64.b64encode(rng.randbytes(300)).decode(), None),
        (703, " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(60)), None),
    ]
    docs = spark.createDataFrame(clean + mixed + foreign, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 4
    assert {r.doc_id for r in langid.keep_known(docs, model).collect()} == set(range(480)) | {600}


def test_ftrl_prefers_few_weights():
    f = langid.Ftrl(10, 1, l1=1.0)
    for _ in range(50):
        at = np.array([1, 2])
        w = f.weights(at)
        f.learn(at, w, np.array([[-1.0], [0.001]]))
    assert f.weights()[1, 0] > 0 and f.weights()[2, 0] == 0


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].toxic == (k % 4 == 0) for k in range(240))
    assert got[1000].severity == got[1001].severity == got[1002].severity == 0 and not got[1003].toxic
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    p = model.chances(model.features, np.ones(len(model.features)))
    assert (np.diff(p) <= 0).all()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0 and doc_id < 240").count() == 0 and kept.count() == docs.count() - 60


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(docs, none)
        assert not toxicity.score(docs, model).where("toxic or severity > 0").count()
    assert toxicity.score(docs.limit(0), toxicity.NOTHING).count() == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    spans += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def test_base_spans_against_brute_force():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789..  -+@ab()é") for _ in range(rng.randint(1, 70)))
        assert pii.base_spans(text) == brute(text), text
    card = "4111 1111 1111 1111"
    assert pii.listed(pii.base_spans(f"é {card} a.b@c.d-e.f 10.0.0.255 +1 (017) 555-7713")) == "card:2:21,email:22:33,ip:34:44,phone:45:62"


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+" * 100_000, "@a" * 50_000):
        pii.base_spans(text)


def test_crf_adds_veiled_spans_and_keeps_base():
    model = pii.train()
    for text, kind in (("call (555) 010-7788 now", 3), ("x 10[.]0[.]0[.]7 y", 1), ("jo.12 [at] example [dot] com ok", 0), ("card 4111.1111.1111.1111 z", 2)):
        base, spans = pii.find(text, model)
        assert not base and [k for _, _, k in spans] == [kind], text
    for text in ("version 3.2.10 of 2024-10-12", "order 123456789012 and page 1234", "plain words only"):
        assert pii.find(text, model) == ([], []), text
    base, spans = pii.find("a@b.cd and 212-555-0199", model)
    assert set(base) <= set(spans) and len(spans) == 2


def test_semi_markov_best_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(1)
    cands = [(i, j, k, [int(x) for x in rng.integers(0, pii.FEATURES, 3)]) for i in range(5) for j in range(i + 1, 6) for k in range(2)]
    model = pii.SemiMarkov(rng.normal(size=pii.FEATURES))
    score = dict(zip([c[:3] for c in cands], model.scores(cands), strict=True))

    def best(i):
        if i >= 5:
            return 0.0
        return max([best(i + 1), *(s + best(j) for (a, j, _), s in score.items() if a == i)])

    assert abs(sum(score[c] for c in model.best(5, cands)) - best(0)) < 1e-9


def test_personal_data_and_mask(spark):
    rows = [(1, "mail a@b.cd or +1 (017) 555-7713", 10), (2, None, None), (3, "", 0), (3, "", 0), (4, "x" * 500_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip, got[1].n_card) == (1, 1, 0, 0) and got[1].spans == "email:5:11,phone:15:32"
    assert got[2].spans == got[3].spans == got[4].spans == ""
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[1].text == "mail <EMAIL> or <PHONE>" and masked[1].n_chars == 23 and masked[2].text is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_long_digits_and_tables_of_numbers():
    assert pii.base_spans("x " + "0" * 5000 + ".1.1.1 y") == [(2, 5008, 1)]
    assert pii.base_spans("x " + "9" * 5000 + ".1.1.1 y") == []
    model = pii.train()
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        pii.find("a@b.cd 12 34 " * n, model)
        pii.find("12 34 " * n, model)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
    address = "jo" * 50 + " [at] " + "mail" * 30 + " [dot] b.c.d.e.f.g.h.example"
    assert pii.find(f"x {address} y", model)[1] == [(2, 2 + len(address), 0)]


def test_partition_function_and_gradient_against_enumeration():
    rng = np.random.default_rng(9)
    cands = [(i, j, k, [int(x) for x in rng.integers(0, pii.FEATURES, 2)]) for i in range(4) for j in range(i + 1, 5) for k in range(2)]
    model = pii.SemiMarkov(rng.normal(size=pii.FEATURES))

    def segmentations(at):
        if at == 4:
            yield []
            return
        yield from segmentations(at + 1)
        for c in cands:
            if c[0] == at:
                for rest in segmentations(c[1]):
                    yield [c, *rest]

    every = list(segmentations(0))
    weight = [np.exp(sum(model.weights[c[3]].sum() for c in s)) for s in every]
    truth = {cands[3][:3]}
    want = np.zeros(pii.FEATURES)
    for s, w in zip(every, weight):
        for c in s:
            np.add.at(want, c[3], -w / sum(weight))
    np.add.at(want, cands[3][3], 1.0)
    got = {}
    model.gradient(4, cands, truth, got)
    full = np.zeros(pii.FEATURES)
    full[list(got)] = list(got.values())
    assert np.allclose(full, want)


# --- the classifiers against plain formulas

MASK, GOLD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def plain_ngrams(text, bits, most=3):
    points = [*map(ord, text.lower().replace("\0", " ")), 0, 0]
    out = {}
    for i in range(len(points) - 2):
        h = 0
        for n in range(1, most + 1):
            if i + n > len(points):
                break
            h = (h * 0x100000001B3 + n + points[i + n - 1]) & MASK
            g = ((h * GOLD) & MASK) >> (64 - bits)
            out[g] = out.get(g, 0) + 1
    return out


def plain_words(text, bits, prefixes=(3, 4, 5, 6, 7)):
    power, out = 0xD6E8FEB86659FD93, {}
    runs = re.findall(r"[^\W\d_]+", text.lower())
    for run in runs:
        h = 0
        for k, c in enumerate(run, 1):
            h = (h + ord(c) + 1) * power & MASK
            if k in prefixes and len(run) > k:
                f = ((h ^ k) * GOLD & MASK) >> (64 - bits)
                out[f] = out.get(f, 0) + 1
        total, p = 0, 1
        for c in run:
            p = p * power & MASK
            total = (total + ord(c) * p) & MASK
        f = ((total ^ (len(run) << 40)) * GOLD & MASK) >> (64 - bits)
        out[f] = out.get(f, 0) + 1
    return out, len(runs)


def test_language_scores_against_plain_formulas(spark):
    docs, _ = corpus(spark)
    model = langid.train(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    import zlib

    trained = [t for d, t, lang in rows if lang and t is not None and not (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1)]
    df = {}
    for t in trained:
        for g in plain_ngrams(t, langid.BITS):
            df[g] = df.get(g, 0) + 1
    idf = np.array([np.log((1 + len(trained)) / (1 + df.get(g, 0))) + 1 for g in range(1 << langid.BITS)])
    assert np.allclose(idf, model.idf)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for d, t, _ in rows:
        if t and re.search(r"[^\W\d_]", t) and len(t) < 10_000:
            x = {g: (1 + np.log(c)) * idf[g] for g, c in plain_ngrams(t, langid.BITS).items()}
            norm = sum(v * v for v in x.values()) ** 0.5
            eta = [sum(v / norm * float(model.weights[g, k]) for g, v in x.items()) + model.bias[k] for k in range(len(model.languages))]
            e = [np.exp(v / model.temperature) for v in eta]
            p = [v / sum(e) for v in e]
            assert got[d].lang_pred == model.languages[int(np.argmax(p))] and abs(got[d].score - max(p)) < 1e-5


def test_ftrl_and_temperature_against_plain_formulas():
    rng = np.random.default_rng(5)
    f = langid.Ftrl(6, 2, alpha=0.3, beta=1.5, l1=0.05, l2=0.1)
    z, n = np.zeros((6, 2)), np.zeros((6, 2))
    for _ in range(40):
        at, g = np.sort(rng.choice(6, 3, replace=False)), rng.normal(size=(3, 2))
        w = f.weights(at)
        for i, a in enumerate(at):
            for k in range(2):
                plain = 0.0 if abs(z[a, k]) <= 0.05 else -(z[a, k] - np.sign(z[a, k]) * 0.05) / ((1.5 + n[a, k] ** 0.5) / 0.3 + 0.1)
                assert abs(plain - w[i, k]) < 1e-12
                z[a, k] += g[i, k] - ((n[a, k] + g[i, k] ** 2) ** 0.5 - n[a, k] ** 0.5) / 0.3 * plain
                n[a, k] += g[i, k] ** 2
        f.learn(at, w, g)
    assert np.allclose(f.z, z) and np.allclose(f.n, n)
    # no other temperature of a finer grid does better on the rows kept out than the one chosen, but for the grid's step
    model = langid.LanguageModel(["a", "b"], idf=np.ones(1 << langid.BITS))
    rows = [(np.sort(rng.choice(200, 12, replace=False) + 40 * (k % 2)), rng.integers(1, 4, 12).astype(float), k % 2 if rng.random() < 0.85 else 1 - k % 2) for k in range(200)]
    langid.fit(model, rows)
    kept = rows[::5]

    def loss(t):
        total = 0.0
        for at, c, y in kept:
            p = langid.softmax((model.vector(at, c) @ model.weights[at] + model.bias) / t)
            total -= np.log(max(p[y], 1e-12))
        return total / len(kept)

    assert all(loss(model.temperature) <= loss(t) + 1e-3 for t in np.geomspace(0.02, 20, 200))


def test_ties_and_repeated_rows_of_languages(spark):
    docs, _ = corpus(spark)
    model = langid.train(docs.unionByName(docs))
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(1, "ka ko", "und", "s", 5, "c", 1)], docs.schema))
    got = langid.identify(twice, model).collect()
    assert len(got) == 2 * 245 + 1
    of = {}
    for r in got[: 2 * 245]:
        assert of.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    even = langid.LanguageModel(["x", "y"], np.ones(1 << langid.BITS), np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(2), 1.0, np.ones((2, 1 << langid.BITS), bool), np.zeros(2))
    assert even.predict(["abc"]) == (["x"], [0.5])


def test_severity_against_plain_formulas(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    weight = dict(zip(model.features.tolist(), model.values.tolist()))
    for r in docs.where("doc_id < 240 or doc_id in (1000, 1001, 1002)").collect():
        counts, n = plain_words(r.text or "", toxicity.BITS)
        eta = sum(weight.get(f, 0.0) * (1 + np.log(c)) for f, c in counts.items())
        p = [1 / (1 + np.exp(t - eta)) if n else 0.0 for t in model.thresholds]
        grades = [1 - p[0], *(a - b for a, b in zip(p, p[1:])), p[-1]]
        assert abs(got[r.doc_id].severity - sum(p)) < 1e-9 and abs(got[r.doc_id].chance - p[0]) < 1e-9
        assert got[r.doc_id].grade == (int(np.argmax(grades)) if n else 0) and got[r.doc_id].toxic == (p[0] >= model.cut)


def test_ordinal_gradient_against_differences():
    t = np.array([-0.5, 0.3, 1.4])

    def loss(eta, k):
        above = np.concatenate([[1.0], toxicity.sigmoid(eta - t), [0.0]])
        return -np.log(above[k] - above[k + 1])

    for eta in (-2.0, 0.1, 3.0):
        above = np.concatenate([[1.0], toxicity.sigmoid(eta - t), [0.0]])
        for k in range(4):
            assert abs((loss(eta + 1e-6, k) - loss(eta - 1e-6, k)) / 2e-6 - (above[k] + above[k + 1] - 1)) < 1e-6


def test_severity_at_the_cut_and_of_repeated_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.unionByName(labels))
    (same,) = {(r.severity, r.chance, r.toxic) for r in toxicity.score(docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4")), model).collect()}
    model.cut = same[1]
    assert toxicity.score(docs.where("doc_id = 4"), model).first().toxic and toxicity.keep_clean(docs.where("doc_id = 4"), model).count() == 0


def test_samples_reach_the_driver_as_packed_numbers(spark, monkeypatch):
    import tracemalloc

    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(400)), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda model, rows: seen.extend(rows) or model)
    tracemalloc.start()
    langid.train(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    numbers = sum(len(at) + len(counts) for at, counts, _ in seen)
    assert len(seen) > 350 and seen[0][0].dtype == np.int64 and seen[0][1].dtype == np.float64
    # 4 bytes a number as they come and 8 as they are learned from; a list of Python integers takes 8 more, and 32 for most
    assert most < 20 * numbers + (8 << 20), (most, numbers)
