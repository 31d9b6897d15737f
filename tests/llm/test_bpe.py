import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken

from quadrat.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library():
    own, other, r = bpe.Bpe.load(PATH, public_tokenizers.PATTERN), library(), random.Random(4)
    pieces = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "'s", "é", "日本", "1", "!", "\xa0", "\t", "😀", "the", "ing", "　", "\x1f", "don't", "aaaa", " "]
    for _ in range(60):
        texts = ["".join(r.choices(pieces, k=r.randint(0, 30))) for _ in range(60)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), repr(text)
            assert own.decode(ids) == text.encode()


def test_very_long_pieces_and_small_ranks():
    own, other, r = bpe.Bpe.load(PATH, public_tokenizers.PATTERN), library(), random.Random(5)
    for text in ("a" * 5000, "ab" * 5000, "".join(r.choices("abcdeAB", k=20000)), "!" * 3001, "é" * 999):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == other.encode_ordinary(text)
    # Ranks in which a longer string is a smaller rank than its parts.
    ranks = {bytes([i]): 100 + i for i in range(256)} | {b"abc": 1, b"bc": 50, b"ab": 60, b"cab": 2, b"aa": 3, b"aab": 0}
    own = bpe.Bpe(ranks, r"[a-z]+")
    other = tiktoken.Encoding("t", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(300):
        text = "".join(r.choices("abc", k=r.randint(1, 20)))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == other.encode_ordinary(text), text


def test_query_rows(spark):
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "x y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.encoding_digests(df, PATH, public_tokenizers.PATTERN).collect()
    other = library()
    want = []
    for i, t in rows:
        ids = np.array(other.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    whole = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN).collect()
    assert {bytes(r.decoded) for r in whole} == {b"Hello  world", b"", b"x y"}


def test_letters_are_merged_once_whatever_stands_behind_them():
    own, other, r = bpe.Bpe.load(PATH, public_tokenizers.PATTERN), library(), random.Random(6)
    merge, merged = own.merge, []

    def counted(pieces):
        merged.extend(pieces)
        return merge(pieces)

    own.merge = counted
    words = sorted({"".join(r.choices("abcdefghé", k=9)) for _ in range(80_000)})
    groups = [words[at : at + 8_000] for at in range(0, len(words), 8_000)]
    texts = [t for g in groups for t in (" " + " ".join(g), " " + ". ".join(g) + ".", " " + ", ".join(g) + "?!")]
    for _ in range(2):
        for text in texts:
            (ids,) = own.encode([text])
            assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert len([p for p in merged if p.startswith(b" ")]) <= len(words)


def test_white_space_of_every_kind():
    own, other = bpe.Bpe.load(PATH, public_tokenizers.PATTERN), library()
    kinds = [c for c in map(chr, range(0x110000)) if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp")]
    texts = [t for c in kinds for t in (f"{c}a{c}{c}b.{c}", f" a {c}b, {c} c.{c}", f"A {c}")] + ["", " ", "a's. b'll, don't.", "é.'s"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
    assert own.encode([]) == []
