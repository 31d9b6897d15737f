import math
import random
import zlib

import numpy as np

from quadrat.llm import language, quality

WORDS = {"aa": "the and of with thing house water people", "bb": "der und die nicht haus wasser straße über"}


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choices(WORDS[lang].split(), k=r.randint(3, 40))), lang))
    return out


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_held_out_texts(spark):
    rows = [*texts(400, 1), (1000, None, "aa"), (1001, "", None), (1002, "12 34 ²½ __", "bb"), (1003, "Wasser über", None), (None, "the house", "aa")]
    df = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].held_out == is_held(i) for i, _, _ in rows if i is not None) and not got[None].held_out
    held = [(i, lang) for i, _, lang in rows[:400] if is_held(i)]
    assert len(held) > 40 and all(got[i].lang_pred == lang for i, lang in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].rejected and not got[1003].rejected
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def plain_vector(text, idf):
    """Hashed 2- to 4-grams in plain Python, one at a time."""
    folded = text.lower().encode()
    folded = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in folded)
    folded = b" " + b" ".join(folded.split()) + b" "
    n = {}
    for size in (2, 3, 4):
        for at in range(len(folded) - size + 1):
            code = folded[at]
            for c in folded[at + 1 : at + size]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ c
            bucket = (code * 0x9E3779B1 & 0xFFFFFFFF) >> 20
            n[bucket] = n.get(bucket, 0) + 1
    v = {b: math.log1p(k) * idf[b] for b, k in n.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / norm for b, x in v.items()}


def test_language_same_as_plain_code(spark):
    rows = [*texts(300, 5), (900, "Haus the wasser of", None), (901, "ß", "bb"), (902, "zzz qqq 77", None), *[(903, "the house", "aa")] * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    train = [(t, lang) for i, t, lang in rows if lang is not None and not is_held(i)]
    seen = {}
    for t, _ in train:
        for b in plain_vector(t, [1.0] * language.DIMENSIONS):
            seen[b] = seen.get(b, 0) + 1
    idf = [math.log((1 + len(train)) / (1 + seen.get(b, 0))) + 1 for b in range(language.DIMENSIONS)]
    model = language.fit(df.filter(~language.held_out()))
    assert np.allclose(model.idf, idf) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    vectors = {(i, t): plain_vector(t, idf) for i, t, _ in rows}
    for r in language.predict(df, model).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        v = vectors[r.doc_id, r.text]
        cosine = [sum(x * float(c[b]) for b, x in v.items()) for c in model.centroids]
        best = max(cosine)
        assert abs(r.score - min(max(best, 0), 1)) < 1e-4 and r.rejected == (1 - r.score > model.limits[len(v).bit_length()])
        assert cosine[[model.languages[o] for o in model.owner].index(r.lang_pred)] > -1 and max(c for c, o in zip(cosine, model.owner, strict=True) if model.languages[o] == r.lang_pred) > best - 1e-4


def test_language_of_many_equal_rows(spark):
    rows = [(None, "the house and the water", "aa")] * 3000 + [(7, "the thing", "aa")] * 2000 + [(i, t, lang) for i, t, lang in texts(200, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.identify(df, sample=50)
    assert got.filter("lang_pred <> 'aa' and doc_id is null").count() == 0 and got.count() == len(rows)


def test_language_rejects_far_texts_by_size(spark):
    r = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    train = [(i, " ".join(r.choices(WORDS[lang].split(), k=r.choice([3, 20, 200]))), lang) for i in range(600) for lang in [r.choice(list(WORDS))]]
    noise = " ".join("".join(r.choices(alphabet, k=6)) for _ in range(500))
    far = [noise, bytes(r.randrange(256) for _ in range(900)).hex(), "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3]
    near = ["the house", "Haus", WORDS["aa"], " ".join([WORDS["bb"]] * 30)]
    docs = train + [(1000 + i, t, None) for i, t in enumerate(far)] + [(2000 + i, t, None) for i, t in enumerate(near)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x.doc_id for x in language.identify(df).collect() if x.rejected}
    assert got == {1000, 1001, 1002}
    # Held against a plain rule.
    size, distance = np.array([3] * 30 + [5] * 10 + [6] * 25), np.array([0.7] * 30 + [0.75] * 10 + [0.4] * 25)
    want = [0.95] * 3 + [min(0.95, 0.75 + 0.15)] * 3 + [0.4 + 0.15] * 8
    assert np.allclose(language.limits(size, distance), want)


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identify(df).collect()] == [("und", 0.0, False)]
    assert language.identify(df.limit(0)).count() == 0


def test_counts_of_long_text_do_not_depend_on_chunks(monkeypatch):
    text = "Some wörds, 42 and more of them. " * 400
    whole = language.counts(text)
    monkeypatch.setattr(language, "CHUNK", 1000)
    assert (language.counts(text) == whole).all() and whole.sum() > 3 * 9000


def test_quality_of_held_out_texts(spark):
    r, docs, labels = random.Random(2), [], []
    for i, text, _ in texts(500, 3):
        good = r.random() < 0.7
        docs.append((i, text if good else " ".join(w + r.choice(["***", "%%%", "!!"]) for w in text.split()), "x"))
        labels.append((i, int(good), 0))
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "text", "x")]
    labels += [(1, None, 0), (None, 1, 0), (3, labels[3][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality_scores(df, lab).collect()}
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [(i, q) for i, q, _ in labels[:500] if is_held(i)]
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.95
    again = {x.doc_id: x.score for x in quality.quality_scores(df, lab).collect()}
    assert again == {i: x.score for i, x in got.items()}


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({x.score for x in quality.quality_scores(df, lab).collect()}) <= 2


def test_quality_same_as_plain_code(spark):
    docs = [(i, t, len(t) + i % 2) for i, t, _ in texts(120, 8)] + [(500, None, None), (501, "", 0), (502, "A, b! | c\n\nc c $$ 9.", 3), *[(503, "twice", 5)] * 2]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(503, 1, 0), (503, 0, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(df, lab, epochs=3)
    got = quality.score(df, machine).collect()
    assert len(got) == len(docs)
    by_id = {i: (t, c) for i, t, c in docs}
    for r in got:
        x = quality.Features().row(*by_id[r.doc_id])
        used = np.flatnonzero(x).tolist()
        logit = machine.bias + sum(machine.weights[i] * x[i] for i in used)
        for n, i in enumerate(used):
            for j in used[n + 1 :]:
                logit += float(machine.factors[i] @ machine.factors[j]) * float(x[i]) * float(x[j])
        want = 1 / (1 + math.exp(-min(max(logit, -30), 30)))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.3)
    words = (by_id[0][0] or "").split()
    n = {}
    for w in words:
        n[zlib.crc32(w.lower().encode()) % quality.WORDS] = n.get(zlib.crc32(w.lower().encode()) % quality.WORDS, 0) + 1
    norm = math.sqrt(sum(math.log1p(k) ** 2 for k in n.values()))
    row = quality.Features().row(*by_id[0])
    assert all(abs(row[b] - math.log1p(k) / norm) < 1e-5 for b, k in n.items()) and np.count_nonzero(row[: quality.WORDS]) == len(n)


def test_quality_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "good words")] * 500 + [(2, "bad %%%")] * 500, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(df, lab, sample=100).count() == 1000
    assert quality.quality_scores(df.limit(0), lab).count() == 0


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    pairs = [sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in range(6) for j in range(i + 1, 6)) for r in x]
    assert np.allclose(m.logits(x), 0.3 + x @ m.weights + pairs)
