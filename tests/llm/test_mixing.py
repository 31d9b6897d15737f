import random

import pytest

from quadrat.llm import mixing


def filled(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows(seed):
    r = random.Random(seed)
    out = [(i, r.choice(["a", "b", "b", "b", "B", "é", None, "z", ""]), "w  " * r.choice([0, 1, 3, 9, 40])) for i in range(400)]
    return [*out, (900, "a", None), (901, "empty", " \t"), (901, "empty", " \t"), (902, "b", "w w w"), (902, "b", "w w w"), (None, "b", "w")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_sums(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "doc_id long, source string, text string, size int, h int")
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    for s, size in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size} and all(abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 20
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size for r in got)
    key = lambda x: sorted(map(repr, x))
    again = mixing.mix(df.repartition(7)).collect()
    assert key(r[:6] for r in again) == key(r[:6] for r in got)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_a_very_long_document_does_not_end_its_source(spark):
    worst = 0
    for seed in (16, 19, 20):  # the long document comes early
        data = [(i, "a", "w " * 10) for i in range(300)] + [(1000, "a", "w " * 4000)] + [(2000 + i, "b", "w " * 10) for i in range(600)]
        df = spark.createDataFrame(data, "doc_id long, source string, text string")
        got = mixing.mix(df, weights=(1, 1), share=1.2, seed=f"s{seed}").collect()
        for s in "ab":
            mine = [r for r in got if r.source == s]
            worst = max(worst, abs(sum(r.taken for r in mine) / mine[0].target - 1))
    assert worst <= 0.01


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_no_words_at_all(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
