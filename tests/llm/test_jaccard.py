import random

import corpus_pipeline
from quadrat.llm import jaccard
from tests.llm.test_simhash import classes


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passage = r.choices(words, k=60)
    docs = []
    for i in range(40):
        base = r.choices(words, k=r.choice([1, 4, 6, 30, 120, 300]))
        docs.append(base + (passage if i % 3 == 0 else []))
        for edits in (1, 2, 5, 9) if i % 2 else ():
            near = list(base)
            for _ in range(edits):
                near[r.randrange(len(near))] = r.choice(words)
            docs.append(near + (passage if i % 3 == 0 else []))
    docs += [[*passage, r.choice(words), *r.choices(words, k=k % 14)] for k in range(60)]
    texts = [" ".join(d) for d in docs] + ["a b", "A  b", "", None, " \t"]
    ids = r.sample(range(10_000), len(texts))
    return [*zip(ids, texts, strict=True), (None, texts[0]), (None, "")]


def kept(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    low = classes(sets, links)
    return {i for i in sets if low[i] == i}


def test_same_as_brute_force(spark, monkeypatch):
    for seed, sample in ((5, 4096), (6, 4)):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, sig string, n long").repartition(5)
        got = jaccard.jaccard_dedup(df)
        assert got.columns == df.columns
        ids = [r.doc_id for r in got.collect()]
        assert len([i for i in ids if i is not None]) == len(set(ids) - {None}) and ids.count(None) == 2
        assert set(ids) - {None} == kept(rows) and len(kept(rows)) < len(rows) - 60


def test_pipeline_stage_finds_near_copies(spark):
    r = random.Random(2)
    base = r.choices([f"w{i}" for i in range(400)], k=300)
    near = [("y" if i % 60 == 7 else w) for i, w in enumerate(base)]
    far = [("z" if i % 20 == 0 else w) for i, w in enumerate(base)]
    rows = [(k, " ".join(t), "de", "a", 1) for k, t in enumerate((base, near, far))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()} == {0, 2}


def test_repeated_ids_and_empty(spark):
    rows = [(4, "a b c d e f"), (4, "u v w x y z"), (7, "u v w x y z"), (9, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.jaccard_dedup(df).collect()) == [4, 4]
    assert jaccard.jaccard_dedup(df.limit(0)).count() == 0


def test_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    def nothing(batches, stars):
        yield from ()

    monkeypatch.setattr(jaccard, "_pairs", nothing)
    test_pipeline_stage_finds_near_copies(spark)


def test_any_radius_finds_all(spark):
    rows = corpus(7)
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").repartition(3)
    for radius in (0, 20):
        assert {r.doc_id for r in jaccard.jaccard_dedup(df, radius=radius).collect()} == kept(rows)
