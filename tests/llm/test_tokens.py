import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quadrat.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello wörld, it's 42!", "a\x1cb \x1f c", "x y　z\x85w", "é é ẛ̣", "<|endoftext|> <|startoftext|>x", "  \n\t ", "word " * 5000, "ΑΣ ΑΣΑ", "same", "same", "İx Kelvin, Å! ﬁne. ПРИВЕТ? don't. o'er.'s 日本。 ...", "a.b, (c) [d]; e—f… ¿qué? n°5."]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_read_back_is_what_the_library_gives(spark):
    rows = [(i * 13 % 101, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    for length in (16, 2048):
        got = tokens.token_digests(df, PATH, 2, length)
        assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_many_words_as_the_library_gives_them():
    r, enc, lib = random.Random(3), tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    letters = "abcdeéüñßÆΣσİıǅﬁ日한ब्द'’.,!|0٣½_-"
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(40)) for _ in range(150)]
    texts += [" ".join("".join(r.choices("etaoinshr", k=r.randint(2, 9))) + r.choice(["", "", ".", ",", "!?"]) for _ in range(300)) for _ in range(20)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_every_letter_with_punctuation_behind_it():
    enc, lib = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    kinds = [c for c in map(chr, range(0x80, 0x1FB00)) if unicodedata.category(c)[0] in "LMN"]
    for tail in ("", ".", ",;", "!?'", "|", "_-", "a.", "%%%"):
        texts = [" ".join(f"{c}{tail} A{c}{tail}" for c in kinds[at : at + 500]) for at in range(0, len(kinds), 500)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, (tail, text[:20])


def test_added_tokens_in_any_case_and_full_caches(monkeypatch):
    enc, lib = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 500)
    texts = ["x<|endoftext|>y", "a <|ENDOFTEXT|> b", "<|EndOfText|>.", "হয়. जज़, Σας ΑΣ.", *(f"word{i} again, some {i}" for i in range(50))]
    for text in texts * 2:
        (ids,) = enc.encode([text])
        assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_letters_are_spelled_once_whatever_stands_behind_them():
    enc, lib, r = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    speller, spelled = enc.speller, []

    class Counted:
        def encode_batch_fast(self, joined, **options):
            spelled.extend(w for s in joined for w in s.split("0"))
            return speller.encode_batch_fast(joined, **options)

    enc.speller = Counted()
    words = sorted({"".join(r.choices("abcdefghé", k=9)) for _ in range(80_000)})
    groups = [words[at : at + 8_000] for at in range(0, len(words), 8_000)]
    texts = [t for g in groups for t in (" ".join(g), ". ".join(g) + ".", ", ".join(g) + "?!")]
    for _ in range(2):
        for text in texts:
            (ids,) = enc.encode([text])
            assert len(ids) // 2 >= len(text.split())
    assert len(spelled) == len(words)
    assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_white_space_of_every_kind():
    enc, lib = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    kinds = [c for c in map(chr, range(0x110000)) if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp")]
    texts = [f"{c}a{c}{c}b.{c}" for c in kinds]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_have_equal_sequences(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * i) for i in range(50)], "doc_id long, text string")
    bounds = tokens.file_bounds(df, 20)
    encoded = tokens.encode_documents(df, PATH, 2, bounds)
    files = tokens.write_token_files(encoded, 3, f"file://{tmp_path}", sequence=32).orderBy("part").collect()
    assert len(files) == 3 and len(bounds) == 2 and sum(f.n_docs for f in files) == 50
    for f in files:
        file = tokens.TokenFile(f.path)
        ids, masks = zip(*(file.sequence(i) for i in range(-(-f.n_tokens // 32))), strict=True)
        assert all(len(x) == 32 for x in ids) and not ids[0].flags.owndata
        mask = np.concatenate(masks)
        assert mask.sum() == f.n_tokens and mask[: f.n_tokens].all()
        assert np.concatenate(ids)[mask].tolist() == file.tokens(0, f.n_tokens).tolist()


def test_empty(spark):
    assert tokens.token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
