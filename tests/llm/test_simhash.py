import random

import pytest
import xxhash

from quadrat.llm import components, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if counts[k] * 2 > len(shingles))


def classes(rows, links):
    low = {i: i for i in rows}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                moved = True
    return low


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    docs = []
    for i in range(60):
        base = r.choices(words, k=r.choice([0, 1, 2, 3, 30, 400]))
        docs.append(" ".join(base))
        if i % 3 == 0 and base:
            base = list(base)
            base[r.randrange(len(base))] = "X"
            docs.append("\t".join(base) + "\n")
    docs += docs[:20] + ["", None, "\x1c \x85", "A b C", "a B c"]
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


def test_same_as_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    prints = {i: plain(t) for i, t in rows}
    for radius, block in ((2, 8192), (2, 8), (4, 4)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        want = classes(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= radius])
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df, 3, radius).collect()}
        assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(3, "one two three four", "a"), (1, "one two three four", "b"), (2, "something else entirely here", "c"), (None, "one two three four", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_dedup(df)
    assert got.columns == df.columns
    assert sorted(r.fp for r in got.collect()) == ["b", "c", "d"]


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("local", [components.LOCAL_EDGES, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)  # 0: rounds of stars to the end
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.id: r.component_id for r in components.components(df, "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}


@pytest.mark.parametrize(("block", "square"), [(1 << 16, 256), (16, 7)])
def test_wide_pairs_are_true_and_every_partner_is_met(spark, monkeypatch, block, square):
    monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
    monkeypatch.setattr(simhash, "WIDE_SQUARE", square)
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    rows = [(i, r.choice(centres), r.choice([0, 1, 4, 5, 80, 99, 100, 125, 126])) for i in range(400)]
    rows = [(i, fp ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))), n) for i, fp, n in rows] + [(1000 + i, centres[0], 7) for i in range(60)]
    df = spark.createDataFrame([(i, fp - (fp >> 63 << 64), n) for i, fp, n in rows], "id long, fp long, n int").repartition(5)
    true = {(a, b) for a, x, m in rows for b, y, n in rows if a < b and m and n and (x ^ y).bit_count() <= 12 and 5 * min(m, n) >= 4 * max(m, n)}
    got = [tuple(x) for x in simhash.fingerprint_pairs(df, 12, (4, 5)).collect()]
    assert set(got) <= true
    assert {x for p in got for x in p} == {x for p in true for x in p}
    if block > len(rows):
        assert sum(a >= 1000 and b >= 1000 for a, b in got) < 2 * 60
