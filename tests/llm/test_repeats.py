import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import repeats


def plain(rows, width):
    """doc_id, n_bytes, n_removed, n_spans, digest of each row, from a table of all windows."""
    least = {}
    raw = [(i, (t or "").encode() if not isinstance(t, bytes) else t) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1 if i is not None else 0):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma", "délta", "e", "zz", "日本"]
    say = lambda n: " ".join(r.choices(words, k=n))
    common, other = say(30), say(14)
    docs = ["", None, "x", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 200, "b" + "ab" * 120, common, common]
    for _ in range(40):
        parts = [say(r.randint(0, 25))]
        for p in r.choices([common, other, common[10:80], say(3), "a" * 60], k=r.randint(0, 3)):
            parts += [p, say(r.randint(0, 4))]
        docs.append("".join(parts))
    docs += docs[15:22]
    ids = list(range(0, 7 * len(docs), 7))
    r.shuffle(ids)
    return list(zip(ids, docs, strict=True)) + [(None, common), (None, None)]


@pytest.mark.parametrize(("seed", "block", "part"), [(1, 6_000_000, 12_000_000), (2, 3000, 2000), (3, 500, 700)])
def test_same_as_brute_force(spark, seed, block, part):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    assert sorted((tuple(r) for r in repeats.repeat_digests(df, 50, block_bytes=block, part_bytes=part).collect()), key=repr) == plain(rows, 50)


def lined(seed, n):
    """Texts with a common line in unlike surroundings, some of them copies or nearly, over several lengths of line."""
    r = random.Random(seed)
    other = lambda k: "".join(r.choices("abcdefghij klmnop", k=k))
    line = "all rights reserved, see the licence for that 1234567890"
    texts = [other(r.randint(0, 90)) + line[: r.choice([30, 40, 47, 49, 56])] + other(r.randint(0, 90)) for _ in range(n)]
    texts += [texts[0], texts[1] + "!", texts[2][3:], texts[3] + texts[4], line[:40] * 3]
    return [(5 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("hot", "block"), [(100, 6_000_000), (100, 8000), (0, 12_000)])
def test_common_line_in_unlike_texts(spark, hot, block):
    rows = lined(6, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((tuple(r) for r in repeats.repeat_digests(df, 50, block_bytes=block, part_bytes=4000, hot=hot).collect()), key=repr) == plain(rows, 50)


def test_windows_of_hot_anchors_are_dealt_out(spark, tmp_path):
    r = random.Random(7)
    line = "a line of forty bytes in very many texts"
    other = lambda: "".join(r.choices("abcdefghij klmnop", k=60))
    df = spark.createDataFrame([(i, (other() + line + other()).encode()) for i in range(500)], "doc_id long, text binary").coalesce(1)
    (listed,) = repeats.write_blocks(df, str(tmp_path)).collect()
    block = repeats.Block(listed["block"], 50, 24)
    hot, often = block.crowded(50, 24)
    assert len(hot) and often.max() > 400
    most = lambda raw, single: np.bincount(repeats._string_parts(raw, single, 64)).max()
    raw, _, single, _ = block.strings(block.hash, repeats.NONE, 50, 24)
    assert most(raw[np.isin(repeats._hash_of(raw), hot)], single[np.isin(repeats._hash_of(raw), hot)]) > 400
    raw, _, single, (anchor, least, last, cls) = block.strings(block.hash, hot, 50, 24)
    assert single.sum() > 400 and most(raw[single], single[single]) < 3 * single.sum() / 64
    # Every window is still asked for once.
    windows = sorted((a, b) for a, x, y in zip(anchor.tolist(), least.tolist(), last.tolist(), strict=True) for b in range(x, y + 1))
    places = zip(block.place - block.last, block.place - block.first, strict=True)
    assert windows == [(a, b) for a, (x, y) in enumerate(places) for b in range(x, y + 1)]
    assert len(cls) == len(anchor) and cls.max() == len(raw) - 1


def test_sql_same_as_brute_force():
    rows = [*corpus(4), (1000, "é" * 400), (1001, "x" + "é" * 400)]
    documents = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", documents)
        assert sorted(db.execute(repeats.SQL).fetchall(), key=repr) == plain(rows, 50)


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 30):
        text = rng.integers(97, 97 + alphabet, 3000).astype(np.uint8)
        for length in (50, 51, 90, 3000):
            h, place, first, last = repeats.anchors(text[:length], 50, 24)
            begins = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
            assert begins.tolist() == list(range(length - 49))
            every = repeats.gram_hashes(text[:length], 24)
            for x, p, a, b in zip(h, place, first, last, strict=True):
                for s in range(a, b + 1):
                    inside = every[s : s + 27]
                    assert p == s + int(inside.argmin()) and x == inside.min()


def test_text_is_cut_and_columns_stay(spark):
    twin = "the same fifty bytes and then a few more of them, é" * 2
    rows = [(2, "start " + twin, "b", None), (1, twin + " end", "a", 3), (3, None, "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, answer long")
    got = repeats.remove_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.block, r.answer) for r in got.collect()} == {1: (twin + " end", "a", 3), 2: ("start ", "b", None), 3: (None, "c", 4)}


def test_empty(spark):
    assert repeats.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
