"""The pipeline, and mixing's sampling, against plain code on a small table."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quadrat.llm import mixing
from tests.llm.test_mixing import filled
from tests.llm.test_repeats import plain as removed
from tests.llm.test_simhash import classes
from tests.llm.test_simhash import plain as simhash


def plain_mix(rows):
    """repeats of each (doc_id, source, text), in order."""
    size = [len((t or "").encode().split()) for _, _, t in rows]
    totals = {}
    for (_, s, _), n in zip(rows, size, strict=True):
        totals[s] = totals.get(s, 0) + n
    target = filled(totals)
    repeats = [0] * len(rows)
    for s, total in totals.items():
        whole = int(target[s] // total) if total else 0
        part = target[s] - whole * total
        h = lambda i: int(hashlib.md5(f"{rows[i][0]}:{mixing.SEED}".encode()).hexdigest()[:15], 16)
        mine = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (h(i), rows[i][0], size[i]))
        until, missing, rest = 0, part, []
        for i in mine:
            until += size[i]
            repeats[i] = whole
            if until <= part and part > 0:
                repeats[i] += 1
                missing -= size[i]
            else:
                rest.append(i)
        near = [(abs(size[i] - missing), h(i), rows[i][0], i) for i in rest if size[i] and part > 0 and abs(size[i] - missing) < missing]
        if near:
            repeats[min(near)[3]] += 1
    return repeats


def cut(rows):
    """Texts after removal of 50-byte repeats, broken characters dropped."""
    out = []
    for i, s, t in rows:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for k in range(len(raw) - 49):
            if any(raw[k : k + 50] in u.encode() for j, _, u in rows if j < i):
                gone[k : k + 50] = True
        out.append((i, s, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")))
    return out


@pytest.fixture
def table():
    r = random.Random(6)
    words = [w + e for w in ("haus", "wasser", "the", "house", "maison", "été", "casa", "niño") for e in ("", "s", "en", "ing", "é")]
    passage = " ".join(r.choices(words, k=20))
    rows = []
    for i in range(70):
        text = " ".join(r.choices(words, k=r.randint(1, 60)))
        rows.append((i * 3, r.choice(["a", "b", None]), text + (" " + passage if i % 5 == 0 else "")))
    rows += [(300 + i, "b", rows[i][2]) for i in range(6)] + [(400, "a", "12 34"), (401, "a", ""), (402, "a", None)]
    r.shuffle(rows)
    return rows


def test_run(spark, tmp_path, table):
    frame = spark.createDataFrame([(i, t, "xx", s, len(t or "")) for i, s, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(i, s, t) for i, s, t in table if t and any(c.isalpha() for c in t)]
    prints = {i: simhash(t) for i, _, t in docs}
    low = classes(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    docs = cut([d for d in docs if low[d[0]] == d[0]])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for (i, _, t), times in zip(docs, plain_mix(docs), strict=True):
        ids = np.array(encoding.encode_ordinary(t), "<u4")
        want += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * times
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(want) > 20


def test_stages_hand_on_documents(spark, table):
    frame = spark.createDataFrame([(i, t, "xx", s, 1) for i, s, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, "").columns == frame.columns
        assert stage(spark, frame.limit(0), "").count() == 0


def test_cut_agrees_with_the_digests(table):
    docs = [(i, s, t) for i, s, t in table if t]
    lengths = {i: len(t.encode()) for i, _, t in cut(docs)}
    for i, n, gone, _, _ in removed([(i, t) for i, _, t in docs], 50):
        assert n - gone >= lengths[i] >= n - gone - 6
