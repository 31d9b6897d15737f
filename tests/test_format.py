"""Records against bytes that are written out by hand, and the charset and format tables."""

import struct

import numpy as np
import pytest

from quadrat.metadata import header_datetime, number_text
from quadrat.sources import charset, columns, dictionary
from quadrat.sources import sav_format as sf
from quadrat.sources.codec import decode_bytecode, raw_counts


def slots(*values):
    return b"".join(v if isinstance(v, bytes) else struct.pack("<d", v) for v in values)


def decoded(raw, size=None):
    pieces = [raw] if size is None else [raw[i : i + size] for i in range(0, len(raw), size)]
    return np.concatenate([np.zeros(0, np.uint64), *decode_bytecode(iter(pieces), 100.0, "<")])


@pytest.mark.parametrize("size", [None, 8, 3])
def test_bytecode_opcodes(size):
    raw = bytes([101, 102, 255, 254, 253, 0, 1, 251]) + struct.pack("<d", 3.14) + bytes([253, 252, 7, 253, 0, 0, 0, 0]) + b"rawbytes" + b"ignored!"
    got = decoded(raw, size)
    assert got.tobytes() == slots(1.0, 2.0) + struct.pack("<Q", sf.SYSMIS) + b" " * 8 + slots(3.14, -99.0, 151.0) + b"rawbytes"


def test_bytecode_ends():
    assert len(decoded(b"")) == 0
    assert decoded(bytes([101, 252] + [0] * 6)).view(float).tolist() == [1.0]
    assert decoded(bytes([101, 102, 0])).tolist() == []
    with pytest.raises(sf.SavError):
        decoded(bytes([253] + [0] * 7))
    with pytest.raises(sf.SavError):
        decoded(bytes([101, 253, 253] + [0] * 5) + b"8 bytes.", 8)
    assert len(decoded(bytes([101, 252, 253] + [0] * 5))) == 1


def test_temporal_arithmetic():
    x = lambda *v: np.array(v, "<f8").view("<u8")
    day = 86400.0
    got = columns.numeric(x(sf.EPOCH_SECONDS, sf.EPOCH_SECONDS + 19723 * day + 5, sf.EPOCH_SECONDS - 1, sf.EPOCH_SECONDS - day - 1, 0.0, np.nan, 1e300, -1e300), "date", "<")
    assert got.cast("int32").to_pylist() == [0, 19723, 0, -1, -141428, 0, 2**31 - 1, -(2**31)]
    assert columns.numeric(x(sf.EPOCH_SECONDS + 0.5, sf.EPOCH_SECONDS - 1.25), "timestamp", "<").cast("int64").to_pylist() == [500000, -1250000]
    assert columns.numeric(x(3600.0, -0.0000019, 1e300), "duration", "<").cast("int64").to_pylist() == [3600000000, -1, 2**63 - 1]


def test_nulls_and_nan():
    raw = np.array([sf.SYSMIS, 0, np.array(np.nan).view("u8"), 1 << 63], "<u8")
    got = columns.numeric(raw, "double", "<")
    assert got.null_count == 1 and got[0].as_py() is None and np.isnan(got[2].as_py()) and str(got[3].as_py()) == "-0.0"
    assert columns.numeric(raw, "date", "<").null_count == 1
    assert columns.numeric(raw.byteswap(), "double", ">")[0].as_py() is None


def test_formats():
    assert str(sf.Format.unpack(5 << 16 | 8 << 8 | 2)) == "F8.2"
    assert [str(sf.Format.unpack(c << 16 | 10 << 8)) for c in (1, 20, 22, 26, 31)] == ["A10", "DATE10", "DATETIME10", "WKDAY10", "PCT10.0"]
    assert sf.Format.unpack(13 << 16) is None
    kinds = {n: sf.Format(n, 8, 0).kind for n in sf.FORMATS.values()}
    assert {n for n, k in kinds.items() if k == "date"} == {"DATE", "ADATE", "JDATE", "EDATE", "SDATE", "MOYR", "QYR", "WKYR"}
    assert {n for n, k in kinds.items() if k == "timestamp"} == {"DATETIME", "YMDHMS"} and kinds["WKDAY"] == kinds["MONTH"] == "double"


def test_charsets():
    assert charset.decode(b"caf\xe9", "windows-1252") == "café"
    assert charset.decode(b"\x81\x8d\x8f\x90\x9d\x80", "windows-1252") == "\x81\x8d\x8f\x90\x9d€"
    assert charset.from_code_page(12345) == charset.from_label("ISO-8859-1 ") == charset.from_label("nonsense") == "windows-1252"
    assert [charset.from_label(x) for x in ("utf-8", "Windows-1251", "cp1250", "iso-8859-15", "SHIFT_JIS", "latin2")] == ["UTF-8", "windows-1251", "windows-1250", "ISO-8859-15", "Shift_JIS", "ISO-8859-2"]
    for name in {*charset.CODE_PAGES.values(), *charset.LABELS.values()}:
        for raw in (bytes(range(256)), b"\xff\xfe\xfd", b"plain"):
            assert isinstance(charset.decode(raw, name), str)
    assert charset.decode(b"\xff\x41", "UTF-8") == "�A"
    assert charset.decode("日本".encode("cp932"), "Shift_JIS") == "日本"


def test_response_sets():
    got = dictionary.parse_mr_sets("$AD6=D1 1 16 AD6. QC Autofill ad6r1 ad6r2 ad6r3\n$colors=C 15 Favorite Colors RED GREEN BLUE\n\0\nnone\n$x=D2 10 5 Label V1 V2\n$bad=Q 1 2\n$short=C 99 Label\n$e=E1 1 2 ab V1")
    assert [(s["name"], s["mr_type"], s["counted_value"], s["label"], s["variables"]) for s in got] == [
        ("AD6", "dichotomy", "1", "AD6. QC Autofill", ["ad6r1", "ad6r2", "ad6r3"]),
        ("colors", "category", None, "Favorite Colors", ["RED", "GREEN", "BLUE"]),
        ("x", "dichotomy", "10", "Label", ["V1", "V2"]),
        ("short", "category", None, "Label", []),
        ("e", "dichotomy", "1", "ab", ["V1"]),
    ]


def test_texts():
    assert header_datetime("16 Feb 26", "10:38:17") == "2026-02-16 10:38:17"
    assert header_datetime("what", "ever") == "what ever"
    assert [number_text(v) for v in (1.0, -3.0, 2.5, sf.HIGHEST, sf.LOWEST)] == ["1", "-3", "2.5", "HIGH", "LOW"]


def test_raw_words_are_counted_by_code():
    rng = np.random.default_rng(4)
    words = rng.choice(np.array([0, 1, 100, 252, 253, 254, 255], np.uint8), (500, 8))
    assert raw_counts(words.view("<u8").ravel()).tolist() == (words == 253).sum(1).tolist()
